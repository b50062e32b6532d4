"""PySpark-native analytics for per-symbol market time series."""
