"""The ``opN_<name>`` queries: thin contracts over the operators of this package."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = Query(run, sql)
        return run

    return keep


from . import queries  # noqa: E402,F401  (fills QUERIES)
