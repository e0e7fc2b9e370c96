"""wavesift: subsequence search over long numeric series, as Spark DataFrames."""
