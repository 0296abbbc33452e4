"""Spark-native analytics over daily price bars: features, validation, models and serving as DataFrame plans."""
