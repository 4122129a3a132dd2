"""Marketplace order analytics on PySpark: cleaning, checks, and business queries."""

from stallworks.sources.tables import Tables

__all__ = ["Tables"]
