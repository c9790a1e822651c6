"""Queries of the document-structure engine and their SQL oracles."""

from __future__ import annotations

from .plans.queries import ORACLES, QUERIES, receipt_fields

flagship = receipt_fields

__all__ = ["ORACLES", "QUERIES", "flagship"]
