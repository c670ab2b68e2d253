"""Continuous runs: frames arrive as files, records leave as segments."""
