"""Registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from planespark.jobs import queries as q
from planespark.jobs import sql

FLAGSHIP = "particles"

#: Queries without SQL: they follow paths through whole planes, or repeat steps; tested against brute force or numpy.
_NO_SQL = ("iterated_thresholds", "skeleton", "watershed", "ultimate_points", "band_passed", "find_maxima", "hull_shapes", "iterated_fits")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(q, name) for name in (*sql.SQL, *_NO_SQL)}


def oracle_sql() -> dict[str, str]:
    return dict(sql.SQL)
