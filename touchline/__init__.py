"""A Spark-native engine for object-tracking and team-sport game-state data."""
