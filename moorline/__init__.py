"""Spark-native analytics over entity-availability feeds."""
