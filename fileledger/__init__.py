"""Tables of tree entries on Spark: comparison, copy, removal and telemetry as DataFrame operations."""
