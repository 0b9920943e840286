"""A temporal-knowledge and corpus-preparation engine on Spark DataFrames."""
