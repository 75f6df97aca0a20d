"""A PySpark-native engine for collections of documents and tables."""

__version__ = "0.1.0"
