"""noetia: a PySpark-native knowledge-graph memory and retrieval engine."""

__version__ = "0.1.0"
