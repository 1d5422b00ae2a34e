"""Structured Streaming jobs over snapshots landing in a folder."""
