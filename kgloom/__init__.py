"""Knowledge-graph analytics and text-corpus jobs on Spark DataFrames."""
