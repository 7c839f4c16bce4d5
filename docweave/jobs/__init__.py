"""Jobs of docweave."""
