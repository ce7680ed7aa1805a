"""Structured Streaming over retrieval traces and library changes."""
