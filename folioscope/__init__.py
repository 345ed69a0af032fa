"""Document comparison and training-data preparation on Spark DataFrames."""
