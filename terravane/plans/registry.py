"""Catalogue of runnable queries, each with the inventory rows it covers and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.session import prepare

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


class Tables:
    """Lazy access to the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = prepare(spark), folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


CATALOGUE: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a function ``Tables -> DataFrame``; ``sql`` gives the same rows in DuckDB."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in CATALOGUE:
            raise ValueError(f"query {name} registered twice")
        CATALOGUE[name] = Query(name, tuple(covers.split()), build, sql)
        return build

    return register


def tidy(column: Column | str, digits: int = 6) -> Column:
    """Half-even rounding for output, so both engines print the same number."""
    column = F.col(column) if isinstance(column, str) else column
    scale = float(10**digits)
    return F.rint(column * scale) / scale + 0.0


def tidy_sql(expression: str, digits: int = 6) -> str:
    scale = f"1e{digits}"
    return f"(round_even(({expression})::DOUBLE * {scale}, 0) / {scale} + 0.0::DOUBLE)"


def tidy_columns(frame: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    return frame.withColumns({name: tidy(name, digits) for name in names})
