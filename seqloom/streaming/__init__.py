"""Events as Structured Streaming."""
