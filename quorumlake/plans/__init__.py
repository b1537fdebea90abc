
"""Registered queries."""
