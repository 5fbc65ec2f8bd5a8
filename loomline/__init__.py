"""loomline: workflow analytics on Spark DataFrames."""
