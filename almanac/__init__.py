"""Station time-series analytics as Spark DataFrame functions."""
