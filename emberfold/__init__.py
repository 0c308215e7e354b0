"""Space-time event analytics over infrastructure networks, on Spark DataFrames."""
