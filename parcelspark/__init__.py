"""Property-market analytics on Spark DataFrames."""
