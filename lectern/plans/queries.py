"""All registered queries of the library with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import library, library2  # noqa: F401  (importing registers the queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(library.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(library.ORACLES)
