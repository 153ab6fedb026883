"""New reports as they arrive."""
