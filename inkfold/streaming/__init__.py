"""The stateless rules applied to Structured Streaming frames."""
