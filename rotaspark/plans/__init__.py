"""End-to-end products."""
