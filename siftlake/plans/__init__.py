"""Footers, indexes, plan reports and plan caches."""
