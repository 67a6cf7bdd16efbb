"""Operators: functions from DataFrame to DataFrame, keyed by symbol or series."""
