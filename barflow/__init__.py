"""Market time-series analytics on Spark DataFrames."""
