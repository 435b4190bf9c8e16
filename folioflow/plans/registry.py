"""Registry of named queries, each with the operator ids it covers and its SQL check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    covers: tuple[str, ...]
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(covers: str, sql: str | None = None):
    """Register a function as a query under its own name."""

    def add(run: Query) -> Query:
        name = run.__name__
        if name in ENTRIES:
            raise ValueError(f"duplicate query {name}")
        ENTRIES[name] = Entry(name, tuple(covers.split()), run, sql)
        return run

    return add


def load_all() -> dict[str, Entry]:
    from folioflow.plans import (  # noqa: F401  registration happens on import
        catalog_flow,
        catalog_layout,
        catalog_names,
        catalog_stores,
        catalog_text,
    )

    return ENTRIES
