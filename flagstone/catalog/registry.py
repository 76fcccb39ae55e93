"""Query registry."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from flagstone.sources.bindings import Tables

MODULES = ["finance", "findings", "state", "reading", "retrieval", "research", "scalars", "pages", "streams", "assessment", "evidence", "judging"]


@dataclass(frozen=True)
class Entry:
    run: Callable[[Tables], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of Tables under a name, with its oracle SQL where there is one."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable:
        if name in ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        ENTRIES[name] = Entry(fn, sql)
        return fn

    return add


def load_all() -> dict[str, Entry]:
    for module in MODULES:
        importlib.import_module(f"flagstone.catalog.{module}")
    return ENTRIES
