"""Company fundamentals on Spark: every operator takes DataFrames and returns a DataFrame."""
