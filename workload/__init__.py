"""Registered queries, their SQL counterparts and the test mapping of the given tables."""
