"""A PySpark-native analytics engine: frames, features, models, statistics."""

__version__ = "0.1.0"
