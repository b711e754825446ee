"""The incremental load, silver and daily metrics as Structured Streaming queries."""
