"""A Spark-native engine that reconciles noisy, repeated readings of semi-structured submissions."""
