"""Star-field analytics on Spark DataFrames."""
