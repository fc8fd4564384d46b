"""tidemark: event-stream analytics on Spark DataFrames."""
