"""Structured Streaming forms of adjudication, scoring and notification."""
