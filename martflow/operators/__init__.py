"""Warehouse operators, each a ``DataFrame -> DataFrame`` function."""
