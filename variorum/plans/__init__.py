"""End-to-end plans built from operators."""
