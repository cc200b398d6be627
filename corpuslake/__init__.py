"""Spark-native analytics for large collections of notes, conversations, change records and tasks."""
