"""Scans, landed payloads and stored tables."""
