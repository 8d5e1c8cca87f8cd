"""Readers and the change table."""
