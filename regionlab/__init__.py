"""regionlab: PySpark-native analytics over nested page/region annotations."""

__version__ = "0.1.0"
