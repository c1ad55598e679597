"""Event-time window aggregation over batch tables and out-of-order streams, on Spark DataFrames."""
