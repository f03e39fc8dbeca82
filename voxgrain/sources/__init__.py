"""Schemas, readers, writers and checks of post datasets."""
