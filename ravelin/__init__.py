"""Spark-native analytics over container-platform security posture data."""
