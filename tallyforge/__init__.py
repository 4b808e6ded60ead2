"""Business valuation over Spark DataFrames: add-backs, multiples, ranges and margins."""
