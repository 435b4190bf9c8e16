"""Readers and writers for the table, text and JSON shapes the engine uses."""
