"""Column functions and quality flags over Structured Streaming frames."""
