"""lakeforge: an analytical SQL engine expressed on Spark DataFrames and Catalyst."""
