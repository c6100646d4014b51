"""Incremental ingestion and clustering."""
