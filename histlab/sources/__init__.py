"""Readers of browser databases, imports, configuration and event logs."""
