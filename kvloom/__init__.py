"""kvloom: hierarchical key-value analytics on Spark DataFrames."""
