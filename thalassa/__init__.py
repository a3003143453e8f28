"""Marine-energy and ocean time-series analytics on Spark DataFrames."""
