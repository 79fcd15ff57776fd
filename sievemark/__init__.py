"""Personal-data discovery and governance on Spark DataFrames."""
