"""Region-hierarchy analytics and corpus preparation on Spark DataFrames."""
