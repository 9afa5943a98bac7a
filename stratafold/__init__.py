"""Spark-native analytics for drillhole and discrete-fracture-network data."""

__version__ = "0.1.0"
