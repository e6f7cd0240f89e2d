"""Streaming forms of the stateful operators, and the jobs that chain them."""
