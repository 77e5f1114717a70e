"""Drawing-sheet tables to a checked structural model, as Spark DataFrames."""
