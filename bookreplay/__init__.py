"""Order-book replay and forecast evaluation on Spark DataFrames."""
