"""Registered queries: a Spark builder, the operators it covers and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from foldwise.catalog.oracle import compose

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    covers: tuple[str, ...]
    build: Builder
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def register(name: str, covers: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Decorator: ``covers`` lists the operator ids of the survey, blank separated."""

    def wrap(build: Builder) -> Builder:
        if name in ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        ENTRIES[name] = Entry(tuple(covers.split()), build, compose(sql, extra) if sql else None)
        return build

    return wrap
