"""leafmill: PDF conformance, symbol encoding and corpus operators on Spark DataFrames."""
