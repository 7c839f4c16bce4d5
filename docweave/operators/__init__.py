"""Operators of docweave."""
