"""The queries of this subpackage: one ``opN_<name>`` for every operator."""

from __future__ import annotations

from folioflow.plans.registry import Entry, Query

ENTRIES: dict[str, Entry] = {}


def query(sql: str | None = None):
    """Register a function as a query under its own name."""

    def add(run: Query) -> Query:
        name = run.__name__
        if name in ENTRIES:
            raise ValueError(f"duplicate query {name}")
        ENTRIES[name] = Entry(name, (name.split("_")[0],), run, sql)
        return run

    return add


def load_queries() -> dict[str, Entry]:
    from folioflow.llm import queries  # noqa: F401  registration happens on import

    return ENTRIES


def documents(spark, sf: str):
    return spark.read.parquet(f"{sf}/documents.parquet")
