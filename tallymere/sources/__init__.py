"""Feeds: payloads to standard records."""
