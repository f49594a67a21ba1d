"""Spark-native analytics over semi-structured professional documents."""
