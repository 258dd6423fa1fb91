"""Document conversion and content extraction as Spark DataFrames."""
