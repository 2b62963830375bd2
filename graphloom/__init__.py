"""graphloom: labelled subgraph matching and data preparation on Spark DataFrames."""
