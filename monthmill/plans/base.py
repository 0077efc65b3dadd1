"""A registered query: how to build it on Spark, and the same in SQL, with one list of result columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 4


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    keys: tuple[str, ...]
    ints: tuple[str, ...]
    #: Rounded to DIGITS, or to n with "name:n"; only final results are rounded.
    nums: tuple[str, ...]

    def _nums(self) -> list[tuple[str, int]]:
        return [(n.partition(":")[0], int(n.partition(":")[2] or DIGITS)) for n in self.nums]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        # Adding 0.0 makes a negative zero positive.
        return self.build(spark, sf_dir).select(
            *self.keys, *[F.col(c).cast("long").alias(c) for c in self.ints], *[(F.round(F.col(c).cast("double"), d) + F.lit(0.0)).alias(c) for c, d in self._nums()]
        )

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        columns = [*self.keys, *[f"CAST({c} AS BIGINT) AS {c}" for c in self.ints], *[f"ROUND(CAST({c} AS DOUBLE), {d}) + 0.0 AS {c}" for c, d in self._nums()]]
        head, _, body = self.sql.partition("\nSELECT ") if self.sql.lstrip().startswith("WITH") else ("", "", self.sql.lstrip().removeprefix("SELECT "))
        return f"{head}\nSELECT {', '.join(columns)} FROM (SELECT {body}) AS result"


REGISTRY: dict[str, Query] = {}


def query(sql: str | None, keys: str = "", ints: str = "", nums: str = ""):
    """Registers a builder under its function's name; the column lists are separated by spaces."""

    def add(build):
        REGISTRY[build.__name__] = Query(build.__name__, build, sql, tuple(keys.split()), tuple(ints.split()), tuple(nums.split()))
        return build

    return add
