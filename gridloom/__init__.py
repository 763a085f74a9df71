"""Map algebra on Spark DataFrames."""
