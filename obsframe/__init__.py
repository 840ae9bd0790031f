"""obsframe: dated, located observations and text corpora as Spark DataFrames."""
