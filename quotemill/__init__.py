"""Spark-native analytics for daily and intraday stock-market data."""
