"""Decisions taken before a plan is built, and the query catalogue."""
