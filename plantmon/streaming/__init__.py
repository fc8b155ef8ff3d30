"""Live monitoring with Structured Streaming, and the batch twin of its gate."""
