"""Analytics over very large file and media catalogues, on Spark DataFrames."""
