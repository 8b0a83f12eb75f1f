"""Insurance rating and portfolio analytics on Spark DataFrames."""
