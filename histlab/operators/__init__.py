"""Operators over the history table."""
