"""docspark: office documents and delimited files as Spark DataFrames."""
