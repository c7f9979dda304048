"""Live accumulation of reception reports."""
