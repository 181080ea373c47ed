"""Text pseudonymisation and privacy analytics on Spark DataFrames."""
