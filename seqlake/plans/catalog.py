"""All registered queries of the feed."""

from __future__ import annotations

from seqlake.plans import registry, rendering, windows

__all__ = ["QUERIES", "SQL", "rendering", "windows"]

QUERIES, SQL = registry.QUERIES, registry.SQL
