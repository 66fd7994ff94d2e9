"""Registered queries with the SQL they are checked against."""
