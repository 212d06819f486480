"""Spark-native terrain, hydrology and stream-network analytics on cell tables."""
