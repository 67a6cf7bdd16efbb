"""Compositions of operators into the jobs a user runs."""
