"""Column expressions, fixed values and the injected text encoder."""
