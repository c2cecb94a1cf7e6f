"""cohortgeo: a PySpark-native engine for vector-geometry studies over grouped observations."""

__version__ = "0.1.0"
