"""histlab: a PySpark-native engine for browsing-history analytics."""

__version__ = "0.1.0"
