"""loomtext: deterministic retrieval and corpus preparation over long texts, on Spark DataFrames."""
