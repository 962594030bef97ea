"""Registered queries with the SQL that must give the same rows."""

from . import inference, jsonqueries, loading, locations, scanning, texts  # noqa: F401  (registration)
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
