"""fiberlake: a PySpark-native analytics engine for distributed acoustic sensing."""

__version__ = "0.1.0"
