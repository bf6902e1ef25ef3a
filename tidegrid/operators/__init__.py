"""Operators on packet logs, segments, windows, splits and results."""
