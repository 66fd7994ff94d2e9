"""Schemas, file listings and table reads and writes."""
