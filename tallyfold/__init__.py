"""Exact cost attribution for metered multi-turn sessions, as Spark jobs."""
