"""Analytics of stop-level human mobility on Spark DataFrames."""
