"""Readers and writers: captions, plans, JSON, run logs."""
