"""Sources of docweave."""
