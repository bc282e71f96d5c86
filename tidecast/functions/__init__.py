"""Column-level helpers (scalar expressions) shared by the operators."""
