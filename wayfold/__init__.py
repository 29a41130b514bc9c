"""Wayfold: Spark-native analytics for embedded graphs and greedy routing."""
