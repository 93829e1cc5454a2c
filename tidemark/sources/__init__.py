"""Scans, provider sources and table merges."""
