"""graphloom: code-graph analytics on Spark DataFrames."""
