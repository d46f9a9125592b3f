"""Document-mention analytics on Spark DataFrames."""
