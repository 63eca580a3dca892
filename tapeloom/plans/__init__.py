"""Registered queries and the SQL each is checked against."""
