"""Tracking and detection metrics as query plans over long tables."""
