"""Queries over the driver's tables, one per operator or group of operators."""
