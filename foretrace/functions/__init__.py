"""Column-level functions (all JVM-side expressions)."""
