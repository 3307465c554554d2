"""Spark-native feature engineering, training and batch scoring for flight delays."""
