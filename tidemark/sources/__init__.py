"""Readers and parsers for landed feed files, and the lake tables they are stored in."""
