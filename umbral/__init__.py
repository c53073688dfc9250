"""Analytics with privacy built in, on Spark DataFrames."""
