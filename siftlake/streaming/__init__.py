"""Filters and projections of a query over files that arrive, by Structured Streaming."""
