"""Relational operators over detections, windows, claims and evidence."""
