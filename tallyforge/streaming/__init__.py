"""Structured Streaming forms of posting and volume queries."""
