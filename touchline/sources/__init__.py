"""Readers and writers of label files, tracking text, CSV and JSON lines, and partitioned state tables."""
