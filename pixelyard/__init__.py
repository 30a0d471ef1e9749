"""Dataset-scale evaluation of vision models on Spark DataFrames."""
