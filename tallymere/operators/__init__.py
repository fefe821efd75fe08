"""Operators over standard records and entities."""
