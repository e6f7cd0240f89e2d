"""Batch plans: the layers end to end, and the dashboard queries."""
