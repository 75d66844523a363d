"""Spark-native analytics for fleets of radar recordings."""
