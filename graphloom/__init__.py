"""graphloom: program-graph analytics on Spark DataFrames."""
