"""Frame-level sports-video analytics on Spark DataFrames."""
