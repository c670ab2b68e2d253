"""Relational, ordered and numeric operators over frames, labels, detections and records."""
