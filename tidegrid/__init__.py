"""Spark engine for irregularly sampled, vector-valued event logs."""

__version__ = "0.1.0"
