"""Sensor-timeline analytics on Spark: DataFrame-to-DataFrame operators."""

__version__ = "0.1.0"
