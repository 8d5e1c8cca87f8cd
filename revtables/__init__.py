"""Analytics over the history of versioned text, as Spark DataFrames."""
