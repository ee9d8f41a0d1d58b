"""Millrace: a governed, typed data layer expressed in PySpark."""
