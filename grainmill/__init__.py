"""PySpark-native engine for corpus preparation and evaluation analytics."""

__version__ = "0.1.0"
