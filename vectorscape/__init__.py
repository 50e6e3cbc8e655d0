"""vectorscape: a PySpark-native engine for semantic spaces over catalogues."""
