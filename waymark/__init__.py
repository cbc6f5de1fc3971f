"""waymark: batch address resolution and address analytics on Spark DataFrames."""
