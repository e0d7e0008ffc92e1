"""Sequence kernels in plain Python: no Spark imports, one call a row."""
