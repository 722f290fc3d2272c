"""docgrain: document retrieval and grounded-answer analytics on Spark DataFrames."""
