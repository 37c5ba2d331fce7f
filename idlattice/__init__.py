"""Identity-record screening at table scale, on Spark DataFrames."""
