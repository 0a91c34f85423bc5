"""cliquora: higher-order network analytics on Spark DataFrames."""
