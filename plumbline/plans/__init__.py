"""End-to-end batch jobs."""
