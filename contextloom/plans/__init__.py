"""Registered queries, composed from operators, and the SQL they are checked against."""
