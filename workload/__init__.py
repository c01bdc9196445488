"""Queries over the driver's test tables, with their reference SQL."""
