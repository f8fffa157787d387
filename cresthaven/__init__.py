"""cresthaven: terrain and point-cloud analytics on Spark DataFrames."""
