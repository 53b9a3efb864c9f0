"""Static network assignment and corpus operators on Spark DataFrames."""
