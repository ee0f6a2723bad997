"""Readers: CSV exports, file headers and adapters over the driver tables."""
