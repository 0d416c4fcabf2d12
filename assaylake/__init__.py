"""Literature-data analytics on Spark DataFrames."""
