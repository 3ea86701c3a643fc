"""quillspan: a PySpark-native engine for text retrieval and web-corpus analytics."""

__version__ = "0.1.0"
