"""The same operators over Structured Streaming sources."""
