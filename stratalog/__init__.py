"""Multi-version key-value analytics on Spark DataFrames."""
