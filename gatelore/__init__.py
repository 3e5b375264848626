"""Gatelore: Spark jobs over gate-level netlists, all designs at once."""
