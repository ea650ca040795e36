"""Logistics analytics on Spark: event streams folded into views, joined with reference tables."""
