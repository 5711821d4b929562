"""Structured Streaming forms of the change feed and of subscription cycles."""
