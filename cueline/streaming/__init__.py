"""Streaming views of the run log."""
