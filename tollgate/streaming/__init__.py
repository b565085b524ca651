"""Transfers as a stream."""
