"""Namespaces, typed tables and their files."""
