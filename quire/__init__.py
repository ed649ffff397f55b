"""quire: document-processing dataflows on Spark DataFrames."""
