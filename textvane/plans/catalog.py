"""All registered queries and, where the result is expressible, their SQL."""

from __future__ import annotations

from importlib import import_module

AREAS = ("relational", "words", "spelled", "relevance", "quality", "vectors", "pages", "streams")


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for area in AREAS:
        part = getattr(import_module(f"{__package__}.{area}"), attribute)
        twice = merged.keys() & part.keys()
        if twice:
            raise ValueError(f"registered twice: {sorted(twice)}")
        merged.update(part)
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")
