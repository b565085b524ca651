"""Readers and writers: transfers, ring patterns, tables, JSON."""
