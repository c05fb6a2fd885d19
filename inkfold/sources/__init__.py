"""Evidence tables derived from stored Parquet, and the sinks for results."""
