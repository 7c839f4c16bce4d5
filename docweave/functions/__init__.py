"""Functions of docweave."""
