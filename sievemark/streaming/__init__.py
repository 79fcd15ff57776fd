"""Message-driven extraction and scanning on Structured Streaming."""
