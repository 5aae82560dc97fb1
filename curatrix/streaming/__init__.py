"""The row-local operators on Structured Streaming."""
