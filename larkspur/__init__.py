"""Review analytics, recommendation and training-data operators on Spark DataFrames."""
