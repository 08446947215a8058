"""stepwell: evidence-selection analytics over Spark DataFrames."""
