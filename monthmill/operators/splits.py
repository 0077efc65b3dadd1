"""Leak-free splits along the month axis.  Sides are month bounds, never row positions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..sources.panel import TIME


def month_ranks(df: DataFrame, time: str = TIME) -> DataFrame:
    """(month, rank) from 1; a row per month of the calendar."""
    return df.select(time).distinct().withColumn("rank", F.row_number().over(Window.orderBy(time)))


def cut_positions(n_months: int, test_share: float = 0.2, gap: int = 0) -> tuple[int, int]:
    """(months that train, months before the test)."""
    if not 0 < test_share < 1 or gap < 0:
        raise ValueError(f"a share of {test_share} with a gap of {gap} months can't be cut")
    test = math.floor(round(n_months * test_share, 9))
    if test < 1 or n_months - test - gap < 1:
        raise ValueError(f"{n_months} months can't hold a test of {test_share:.0%} with a gap of {gap} months")
    return n_months - test - gap, n_months - test


def cut_report(df: DataFrame, test_share: float = 0.2, gap: int = 0, time: str = TIME) -> DataFrame:
    """One row: n_months, train_end, test_start and the last training and first test month."""
    ranks = month_ranks(df, time)
    n = ranks.agg(F.count(F.lit(1)).alias("n_months"))
    cut = n.select(
        "n_months",
        (F.col("n_months") - F.floor(F.round(F.col("n_months") * test_share, 9)) - gap).alias("train_end"),
        (F.col("n_months") - F.floor(F.round(F.col("n_months") * test_share, 9))).alias("test_start"),
    )
    joined = ranks.join(F.broadcast(cut), F.lit(True))
    return joined.groupBy("n_months", "train_end", "test_start").agg(
        F.max(F.when(F.col("rank") <= F.col("train_end"), F.col(time))).alias("last_train_month"),
        F.min(F.when(F.col("rank") > F.col("test_start"), F.col(time))).alias("first_test_month"),
    )


def holdout_labels(df: DataFrame, test_share: float = 0.2, gap: int = 0, time: str = TIME) -> DataFrame:
    """``df`` with ``side``: train, gap or holdout; no shuffle of ``df``.

    The months of the calendar are collected and cut once, so that what reads the rows, pass after pass, doesn't look for the cut again.
    """
    months = df.sparkSession.createDataFrame(df.select(time).distinct().collect(), StructType([df.schema[time]]))
    cut = cut_report(months, test_share, gap, time).first()
    bound = lambda name: F.lit(cut[name] if cut else None).cast(df.schema[time].dataType)
    side = F.when(F.col(time) <= bound("last_train_month"), "train").when(F.col(time) >= bound("first_test_month"), "holdout").otherwise("gap")
    return df.withColumn("side", side)


def fold_bounds(n_months: int, folds: int = 5, test_months: int = 3, gap: int = 0, least: int = 6) -> list[tuple[int, int, int, int]]:
    """(fold, train_end, test_start, test_end) as month ranks, oldest first."""
    if folds < 1 or test_months < 1 or gap < 0:
        raise ValueError("folds and test months must be positive, the gap not negative")
    found = []
    for step in range(folds):
        end = n_months - step * test_months
        start = end - test_months
        if start < 0 or start - gap < least:
            break
        found.append((start - gap, start, end))
    return [(k, *f) for k, f in enumerate(reversed(found), 1)]


def fold_months(df: DataFrame, folds: int = 5, test_months: int = 3, gap: int = 0, least: int = 6, time: str = TIME) -> DataFrame:
    """(month, fold, fold_side); a month stands in every fold that uses it.

    The months of the calendar are collected, so that what joins them, job after job, doesn't look for them again.
    """
    spark: SparkSession = df.sparkSession
    ranks = month_ranks(df, time).collect()
    bounds = fold_bounds(len(ranks), folds, test_months, gap, least)
    side = lambda rank, train_end, start, end: "train" if rank <= train_end else "validate" if start < rank <= end else None
    # Months times folds: a few hundred rows.
    rows = [(r[time], fold, side(r["rank"], *ends)) for r in ranks for fold, *ends in bounds]
    return spark.createDataFrame([x for x in rows if x[2]], StructType([df.schema[time], StructField("fold", IntegerType()), StructField("fold_side", StringType())]))


def expanding_folds(df: DataFrame, folds: int = 5, test_months: int = 3, gap: int = 0, least: int = 6, time: str = TIME) -> DataFrame:
    """``df`` tagged with (fold, fold_side); a row stands in every fold that uses it."""
    return df.join(F.broadcast(fold_months(df, folds, test_months, gap, least, time)), time)


def leak_check(tagged: DataFrame, time: str = TIME) -> DataFrame:
    """Per fold: last training month, first validation month, and whether all training comes before."""
    return (
        tagged.groupBy("fold")
        .agg(F.max(F.when(F.col("fold_side") == "train", F.col(time))).alias("last_train"), F.min(F.when(F.col("fold_side") == "validate", F.col(time))).alias("first_validate"))
        .withColumn("no_leak", F.col("last_train") < F.col("first_validate"))
    )


def split_on_boundary(df: DataFrame, boundary, time: str = TIME) -> tuple[DataFrame, DataFrame]:
    """Rows up to the boundary and rows after it; an error if none are after."""
    after = df.filter(F.col(time) > F.lit(boundary))
    if after.isEmpty():
        raise ValueError(f"no rows after {boundary}")
    return df.filter(F.col(time) <= F.lit(boundary)), after


def out_of_sample(scored: DataFrame, trained: DataFrame, time: str = TIME) -> DataFrame:
    """One row: first scored month, the models' last training month, whether they agree on it and it comes before."""
    first = scored.agg(F.min(time).alias("first_scored"))
    last = trained.agg(F.max("trained_through").alias("trained_through"), (F.countDistinct("trained_through") == 1).alias("models_agree"))
    return first.join(F.broadcast(last), F.lit(True)).withColumn("out_of_sample", F.col("models_agree") & (F.col("first_scored") > F.col("trained_through")))
