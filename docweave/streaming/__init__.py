"""Streaming of docweave."""
