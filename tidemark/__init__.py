"""tidemark: process, control-chart and service-level analytics on Spark DataFrames."""
