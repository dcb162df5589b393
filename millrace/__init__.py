"""A batch analytics engine on Spark DataFrames."""
