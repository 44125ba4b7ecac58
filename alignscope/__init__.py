"""Knowledge-graph alignment-benchmark analytics on Spark DataFrames."""
