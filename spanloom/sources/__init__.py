"""Files of signal tracks and sequences as Spark data sources."""
