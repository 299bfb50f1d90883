"""A query and pipeline engine on Spark DataFrames."""
