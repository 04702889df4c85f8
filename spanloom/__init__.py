"""Range queries over collections of signal tracks, and interval algebra, on Spark."""

__version__ = "0.1.0"
