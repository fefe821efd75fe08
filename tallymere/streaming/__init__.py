"""Continuous ingestion of landing folders."""
