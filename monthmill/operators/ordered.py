"""Ranks, running sums and exact quantiles of values that no single task could sort.

Quantiles: approximate ones bracket the rows in question; a second pass counts what lies below
a bracket and, by value, what lies inside.  Running sums: a value's octave and the 4,096th of it
grow with the value, so a group is summed by octaves, buckets and values.  Nothing is collected: a query
that is built runs no job, and results don't depend on the approximation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: approx_percentile's ranks are off by at most 1 / ACCURACY of the rows.
ACCURACY = 10_000
#: Buckets of an octave.
FINE = 4096
#: Above the logarithm of any double's inverse, so that buckets of positive values are positive.
_LIFT = 1076


def with_group(df: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` with the columns of its group's row; null is a group like any other."""
    key = F.struct(F.lit(0), *by)
    return df.withColumn("_g", key).join(F.broadcast(groups.select(key.alias("_g"), *[c for c in groups.columns if c not in by])), "_g").drop("_g")


#: A long that never falls as the double grows: 0 for 0 and -0, NaN above everything, null for null.
_BUCKET = f"CASE WHEN isnan({{v}}) THEN {(1 << 63) - 1} WHEN {{v}} = 0 THEN 0 ELSE CAST(signum({{v}}) AS BIGINT) * floor((log2(abs({{v}})) + {_LIFT}) * {FINE}) END"


def bucket_of(column: str) -> Column:
    return F.expr(_BUCKET.format(v=f"CAST(`{column}` AS DOUBLE)"))


def _window(by: Sequence[str], *order: str) -> Window:
    return Window.partitionBy(*by or [F.lit(0)]).orderBy(*[F.col(c).asc_nulls_last() for c in order])


def sum_before(df: DataFrame, by: Sequence[str], value: str, weight: str, name: str) -> DataFrame:
    """``df`` (one row per group and value) with the sum of ``weight`` over the group's smaller values; nulls come last.

    Three windows: over a group's octaves, over an octave's buckets, and over a bucket's values.
    """
    before = lambda w, of: F.coalesce(F.sum(of).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keyed = df.withColumn("_d2", bucket_of(value)).withColumn("_d1", F.floor(F.col("_d2") / FINE))
    second = keyed.groupBy(*by, "_d1", "_d2").agg(F.sum(weight).alias("_w"))
    first = second.groupBy(*by, "_d1").agg(F.sum("_w").alias("_w"))
    first = first.select(*by, "_d1", before(_window(by, "_d1"), "_w").alias("_ahead1"))
    second = second.withColumn("_ahead2", before(_window([*by, "_d1"], "_d2"), "_w")).drop("_w")
    same = lambda a, b, keys: a.withColumn("_k", F.struct(F.lit(0), *keys)).join(b.withColumn("_k", F.struct(F.lit(0), *keys)).drop(*keys), "_k").drop("_k")
    ahead = same(second, first, [*by, "_d1"]).drop("_d1")
    inside = before(_window([*by, "_d2"], value), weight)
    placed = same(keyed.withColumn("_inside", inside), ahead, [*by, "_d2"])
    return placed.withColumn(name, F.col("_inside") + F.col("_ahead1") + F.col("_ahead2")).drop("_d1", "_d2", "_inside", "_ahead1", "_ahead2")


def average_ranks(df: DataFrame, by: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """(by..., value, t, rank): each distinct value with its number of rows and their average rank."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("t"))
    return sum_before(counts, by, value, "t", "_before").withColumn(name, F.col("_before") + (F.col("t") + 1) / 2.0).drop("_before")


def exact_quantiles(df: DataFrame, value: str, points: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., point, n, q): exact quantiles between neighbouring values, as of the sorted column without nulls.

    For groups that are few and may be large.  A bracket of approximate quantiles holds the two
    rows in question; rows below are counted, those inside are counted by value.  NaN
    counts as the largest value.
    """
    known = df.select(*by, F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    reach = 2 / ACCURACY
    ends = [p for x in points for p in (max(0.0, x - reach), min(1.0, x + reach))]
    rough = known.groupBy(*by).agg(
        F.percentile_approx("v", F.array(*map(F.lit, ends)), ACCURACY).alias("e"), F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most")
    )
    # Where a bracket's reach is less than a row or two, everything lies inside.
    end = lambda k, other: F.when(F.col("n") <= ACCURACY, F.col(other)).otherwise(F.get("e", F.lit(k)))
    each = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("point"), end(2 * k, "least").alias("low"), end(2 * k + 1, "most").alias("high")) for k, x in enumerate(points)]))
    brackets = rough.select(*by, "n", each.alias("b")).select(*by, "n", "b.*")
    held = with_group(known, brackets, by)
    # Everything below a bracket is one value to its counts.
    place = F.when(F.col("v") >= F.col("low"), F.col("v"))
    counts = held.filter("v <= high").groupBy(*by, "point", "n", place.alias("v")).agg(F.count(F.lit(1)).alias("t"))
    upto = Window.partitionBy(*by, "point").orderBy(F.col("v").asc_nulls_first())
    ranked = counts.withColumn("upto", F.sum("t").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.col("point") * (F.col("n") - 1)
    # The first value whose running count passes a rank holds that rank.
    first = lambda rank: F.min(F.when(F.col("upto") > rank, F.struct("upto", "v"))).getField("v")
    ends = ranked.groupBy(*by, "point", "n").agg(first(F.floor(at)).alias("a"), first(F.ceil(at)).alias("b"))
    share = F.col("point") * (F.col("n") - 1) - F.floor(F.col("point") * (F.col("n") - 1))
    q = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - share) * F.col("a") + share * F.col("b"))
    return ends.select(*by, "point", "n", q.alias("q"))


def quantile_columns(df: DataFrame, value: str, points: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., a column per named point): ``exact_quantiles`` side by side; without ``by`` one row, null without values."""
    got = exact_quantiles(df, value, tuple(points.values()), by)
    return got.groupBy(*by).agg(*[F.max(F.when(F.col("point") == F.lit(float(p)), F.col("q"))).alias(n) for n, p in points.items()])


def median_row(df: DataFrame, value: Column, name: str) -> DataFrame:
    """One row with the exact median of ``value`` as ``name``; null if there is none."""
    return quantile_columns(df.select(value.alias("v")), "v", {name: 0.5})
