"""memlake: a PySpark-native analytics engine for long-lived agent memory."""

__version__ = "0.1.0"
