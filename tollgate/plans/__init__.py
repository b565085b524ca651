"""Registered queries over the driver's tables, and experiments composed of operators."""
