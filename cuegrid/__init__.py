"""cuegrid: corpus-wide analytics over timed media data, on Spark DataFrames."""
