"""Scheduled ingestion and de-duplication across runs."""
