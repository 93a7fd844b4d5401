"""Schemas, typed expressions, filtered scans and the system catalog."""
