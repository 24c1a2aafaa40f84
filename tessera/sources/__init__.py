"""Readers, connectors and writers."""
