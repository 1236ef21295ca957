"""Column-level functions and the counter-based random numbers."""
