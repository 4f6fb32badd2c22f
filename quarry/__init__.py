"""quarry: a PySpark-native engine for content-addressed data."""
