"""Spark-native geospatial entity resolution and corpus preparation."""
