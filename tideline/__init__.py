"""PySpark-native robust locally weighted smoothing of one-dimensional series."""

__version__ = "0.1.0"
