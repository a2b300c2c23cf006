"""Privacy engineering on Spark DataFrames."""
