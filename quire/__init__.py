"""Document analytics on Spark: pages and positioned blocks of text as DataFrames."""
