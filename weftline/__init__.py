"""weftline: a PySpark-native engine for aligning, segmenting and mining ordered token data."""

__version__ = "0.1.0"
