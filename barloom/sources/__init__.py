"""Readers of curated Parquet tables and raw vendor files."""
