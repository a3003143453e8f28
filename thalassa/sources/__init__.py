"""Readers, and tables on their way."""
