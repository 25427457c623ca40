"""Registration of named queries."""

from __future__ import annotations

from collections.abc import Callable

from cartulary.sources.records import ITEMS_SQL, MEMORY_SQL, MESSAGES_SQL, NOTES_SQL, SECTIONS_SQL

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
WITH_ITEMS = f"WITH items AS ({ITEMS_SQL})"
#: Views that an oracle may ask for, with what they build on.
VIEWS = {"items": {"items": ITEMS_SQL}, "notes": {"notes": NOTES_SQL}, "sections": {"notes": NOTES_SQL, "sections": SECTIONS_SQL}, "memory": {"memory": MEMORY_SQL}, "messages": {"messages": MESSAGES_SQL}}


def query(sql: str | None = None, items: bool = False, views: tuple[str, ...] = (), ctes: str = "") -> Callable:
    """Register a function (spark, sf_dir) under its name; sql is what DuckDB must equal, over views if asked, and common table expressions after them."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql and (views or ctes):
            parts = {name: text for v in views for name, text in VIEWS[v].items()}
            listed = [f"{name} AS ({text})" for name, text in parts.items()] + ([ctes] if ctes else [])
            ORACLES[f.__name__] = f"WITH {', '.join(listed)} {sql}"
        elif sql:
            ORACLES[f.__name__] = f"{WITH_ITEMS}{',' if items == 'more' else ''} {sql}" if items else sql
        return f

    return register
