"""Operators for preparing large text corpora: deduplication, extraction, scoring, mixing.

Nothing else in the library imports this subpackage.
"""
