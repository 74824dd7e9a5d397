"""Analytics of topic research corpora on Spark DataFrames."""
