"""Reusable plan pieces, and the registered queries with their SQL."""
