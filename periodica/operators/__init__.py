"""Part of the geometry engine."""
