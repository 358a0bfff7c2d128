"""ocspark: object-centric process analytics on Spark DataFrames."""
