"""The same reports over an inventory stream (Structured Streaming)."""
