"""featherbit: text features, sparse bit sets, vector clustering and clause learning on Spark DataFrames."""
