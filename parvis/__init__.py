"""parvis: a PySpark-native engine that builds and searches a catalog of places and organisations."""

__version__ = "0.1.0"
