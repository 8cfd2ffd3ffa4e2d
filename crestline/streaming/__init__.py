"""Live forms of the operators on Structured Streaming."""
