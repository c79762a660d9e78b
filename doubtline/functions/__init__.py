"""Column-level building blocks (vectors, probabilities, hashing, Student-t)."""
