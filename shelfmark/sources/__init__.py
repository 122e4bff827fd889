"""Landed payloads, fetch outcomes, and the index on storage."""
