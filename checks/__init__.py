"""Registered queries over the given tables and the SQL each one is compared with."""
