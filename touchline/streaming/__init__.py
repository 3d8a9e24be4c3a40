"""Keyed state over frame streams: trackers, windows, replays."""
