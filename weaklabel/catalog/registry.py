"""Registered queries: a Spark function and, where SQL can say the same, its SQL text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: tuple[str, ...]


CATALOG: dict[str, Entry] = {}


def query(covers: str, sql: str | None = None):
    """Register a query under its function name. ``covers`` names the inventory rows it shows."""

    def register(run):
        if run.__name__ in CATALOG:
            raise ValueError(f"{run.__name__} is registered twice")
        CATALOG[run.__name__] = Entry(run, sql.strip() if sql else None, tuple(covers.split()))
        return run

    return register
