"""Analytics over crawled web corpora, expressed with Spark DataFrames and SQL."""
