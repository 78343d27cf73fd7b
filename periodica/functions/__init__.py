"""SQL functions of the engine."""
