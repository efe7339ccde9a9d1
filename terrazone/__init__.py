"""PySpark-native analytics for multispectral field rasters."""

__version__ = "0.1.0"
