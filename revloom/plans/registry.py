"""Every query by name, and its SQL."""

from __future__ import annotations

from .queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
