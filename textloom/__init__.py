"""textloom: text-quality and correction analytics on Spark DataFrames."""
