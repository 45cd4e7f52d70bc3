"""Traffic-schema analytics on Spark: learn the schema of an HTTP API from recorded
exchanges, emit it, and grade how it drifts."""
