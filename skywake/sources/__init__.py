"""Snapshot files and stored state."""
