"""Composed plans: the research pipeline and the registered queries with their SQL."""
