"""Column builders: URLs, times and text."""
