"""Event operators, for batch and Structured Streaming."""
