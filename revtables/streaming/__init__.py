"""Structured Streaming form of the history build."""
