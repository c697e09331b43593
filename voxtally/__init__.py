"""Spark-native analytics over cohorts of labelled 3-D volumes."""
