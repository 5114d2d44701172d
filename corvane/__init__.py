"""corvane: governed-document retrieval and analytics on Spark DataFrames."""
