"""quireflow: retrieval, graph and data-quality operators for manual corpora on Spark DataFrames."""
