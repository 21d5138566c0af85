"""Readers: parquet tables, file listings, stored documents."""
