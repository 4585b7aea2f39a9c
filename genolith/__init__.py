"""genolith: interval, tensor and mutation analytics expressed as Spark DataFrames."""
