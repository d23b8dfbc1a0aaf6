"""Vector retrieval, evaluation and rule jobs on Spark DataFrames."""
