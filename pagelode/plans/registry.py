"""Collects the queries and checking SQL of all plan modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODULES = ["urls", "links", "redaction", "capture", "dom", "styles", "calls",
           "entities", "trees", "interaction", "tasks", "reports", "streams", "history", "structure"]

Query = Callable[[SparkSession, str], DataFrame]


def _modules():
    return [importlib.import_module(f"{__package__}.{name}") for name in MODULES]


def _plain(run: Query) -> Query:
    """Integers leave as BIGINT, so both engines print and hash them alike."""
    def wrapped(spark: SparkSession, sf: str) -> DataFrame:
        df = run(spark, sf)
        return df.select(*[
            F.col(f.name).cast("long").alias(f.name)
            if f.dataType.simpleString() in ("int", "smallint", "tinyint") else F.col(f.name)
            for f in df.schema.fields
        ])
    return wrapped


def queries() -> dict[str, Query]:
    return {name: _plain(run) for module in _modules() for name, run in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.ORACLES.items()}
