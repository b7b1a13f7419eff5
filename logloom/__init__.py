"""Structured log analytics on PySpark: parse, filter, rewrite, tag, aggregate, window and export."""

from logloom.schema import LOG_COLUMNS, LOG_SCHEMA

__all__ = ["LOG_COLUMNS", "LOG_SCHEMA"]
