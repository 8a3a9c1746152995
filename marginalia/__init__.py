"""Analytics over a personal knowledge archive, as Spark DataFrames."""
