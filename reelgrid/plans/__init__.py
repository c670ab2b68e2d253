"""Whole flows: a game's frames to records, and the labeling requests."""
