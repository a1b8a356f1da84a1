"""probatum: checking research claims at scale on Spark DataFrames."""
