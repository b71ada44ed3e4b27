"""A knowledge-graph memory engine on Spark DataFrames."""
