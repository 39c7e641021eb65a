"""Time-series identification and training-data preparation as Spark jobs."""
