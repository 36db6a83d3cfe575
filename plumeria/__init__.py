"""Robust stacking of aligned frames, and corpus preparation, as Spark jobs."""
