"""Time-series, change-data and event analytics as Spark DataFrames."""
