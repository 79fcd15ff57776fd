"""Readers that turn listings, files and annotation answers into tables."""
