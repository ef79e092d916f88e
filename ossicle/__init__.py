"""Signal-robustness analytics on Spark DataFrames."""
