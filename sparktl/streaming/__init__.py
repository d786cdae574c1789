"""Live monitoring of traces with Structured Streaming state."""
