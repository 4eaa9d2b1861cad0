"""Set-based workload cost analytics on Spark DataFrames."""
