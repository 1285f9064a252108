"""Business-record linkage on Spark DataFrames."""
