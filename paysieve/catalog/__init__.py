"""Registered queries: each pairs a library call on the given tables with its SQL twin."""
