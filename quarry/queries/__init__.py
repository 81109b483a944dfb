"""Every operator applied to the driver tables, beside its equivalent in DuckDB SQL."""

from __future__ import annotations

from quarry.queries import chunks, files, reports, search, texts, vectors


def all_queries() -> dict:
    """Name -> (query, SQL or None)."""
    out: dict = {}
    for module in (files, texts, chunks, vectors, search, reports):
        out.update(module.QUERIES)
    return out
