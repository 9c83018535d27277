"""Source-code indexing and ranked search on Spark DataFrames."""
