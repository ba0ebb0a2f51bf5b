"""Whole plans: the copy-ratio chain, the table projections and the query catalogue."""
