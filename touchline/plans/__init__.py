"""Whole analyses composed of operators: stages, topology, evaluation."""
