"""Structured Streaming editions of event queries."""
