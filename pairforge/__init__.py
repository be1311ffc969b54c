"""pairforge: pairwise and vector data mining over Spark DataFrames."""
