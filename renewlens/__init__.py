"""Subscription lifecycle analytics on Spark: feeds, typed tables, marts and metrics."""
