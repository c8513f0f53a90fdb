"""The table of registered queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.plans.durable import shared_folder

DIGITS = 6


@dataclass(frozen=True)
class Query:
    run: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(self.run(Tables(spark, sf_dir)))


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of the tables under its name."""

    def register(run):
        QUERIES[name or run.__name__] = Query(run, sql)
        return run

    return register


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, as in the SQL; also turns -0.0 into 0.0."""
    return df.select(*[
        (F.round(F.col(f"`{name}`"), DIGITS) + F.lit(0.0)).alias(name) if kind == "double"
        else F.col(f"`{name}`")
        for name, kind in df.dtypes
    ])


def r(expression: str) -> str:
    """SQL for the same rounding."""
    return f"round({expression}, {DIGITS}) + 0"


class Tables:
    """The given tables, and the views on them that the queries share."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def fresh_path(t: Tables, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"
