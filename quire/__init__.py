"""Page-level text curation and book assembly on Spark DataFrames."""
