"""Schemas, readers, writers and stand-in views over the supplied tables."""
