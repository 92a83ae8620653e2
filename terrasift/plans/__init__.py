"""Registered queries with the SQL that gives the same rows."""
