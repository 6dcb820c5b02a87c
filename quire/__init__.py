"""quire: document-recognition analytics and corpus preparation as Spark DataFrames."""
