"""Exploration and data-quality jobs as aggregates."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import median
from ..sources.panel import COUNTS, ID, TARGET, TIME
from .ordered import average_ranks, median_row, quantile_columns


def unpivoted(df: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., column, value) rows of numeric columns."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keep), columns, "column", "value")


def target_quantiles(df: DataFrame, target: str = TARGET) -> DataFrame:
    points = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    ends = df.agg(F.min(target).alias("min"), F.max(target).alias("max"), F.avg(target).alias("mean"))
    one = ends.join(F.broadcast(quantile_columns(df, target, points)), F.lit(True))
    return one.select("min", *points, "max", "mean").withColumn("middle_90", F.col("p95") - F.col("p5"))


def target_over_time(df: DataFrame, target: str = TARGET) -> DataFrame:
    q = F.percentile(target, F.array(*map(F.lit, (0.5, 0.1, 0.25, 0.75, 0.9))))
    m = df.groupBy(TIME).agg(F.avg(target).alias("mean"), q.alias("q"), F.count(target).alias("n_rows"))
    m = m.select(TIME, "mean", *[F.get("q", F.lit(k)).alias(n) for k, n in enumerate(("median", "p10", "p25", "p75", "p90"))], "n_rows")
    by_time = Window.orderBy(TIME)  # a row per month
    m = m.withColumn("move", F.col("mean") - F.lag("mean").over(by_time))
    return m.withColumn("largest_move", F.coalesce(F.abs(F.col("move")) == F.max(F.abs(F.col("move"))).over(Window.partitionBy(F.lit(0))), F.lit(False)))


def missing(df: DataFrame, columns: list[str], first_months: int = 3) -> DataFrame:
    """Per column: missing count, percent, and the share of its missing cells in users' first months."""
    early = F.row_number().over(Window.partitionBy(ID).orderBy(TIME)) <= first_months
    long = unpivoted(df.withColumn("early", early), columns, ("early",))
    gone = F.col("value").isNull()
    return long.groupBy("column").agg(
        F.count_if(gone).alias("n_missing"),
        (100 * F.avg(gone.cast("double"))).alias("percent_missing"),
        F.try_divide(F.count_if(gone & F.col("early")), F.nullif(F.count_if(gone), F.lit(0))).alias("early_share"),
    )


def symlog_histogram(df: DataFrame, column: str = TARGET, bins: int = 40, heavy: float = 30.0) -> DataFrame:
    """(bin, n_rows) even in symlog space where the tails are heavy (span / IQR above ``heavy``), else even."""
    s = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    for part in (quantile_columns(df, column, {"q1": 0.25, "q3": 0.75}), median_row(df, F.abs(column), "mid")):
        s = s.join(F.broadcast(part), F.lit(True))
    s = s.withColumn("heavy", F.coalesce(F.try_divide(F.col("hi") - F.col("lo"), F.nullif(F.col("q3") - F.col("q1"), F.lit(0.0))) > heavy, F.lit(True)))
    s = s.withColumn("linear", F.greatest(F.col("mid") / 10, F.lit(1.0)))

    def squash(c: Column) -> Column:
        return F.when(F.col("heavy"), F.signum(c) * F.log1p(F.abs(c) / F.col("linear"))).otherwise(c)

    s = s.withColumns({"a": squash(F.col("lo")), "b": squash(F.col("hi"))})
    x = df.select(F.col(column).alias("x")).filter("x IS NOT NULL").join(F.broadcast(s), F.lit(True))
    place = F.floor(F.try_divide((squash(F.col("x")) - F.col("a")) * bins, F.nullif(F.col("b") - F.col("a"), F.lit(0.0))) + 1e-9)
    return x.withColumn("bin", F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("long")).groupBy("bin", "heavy").agg(F.count(F.lit(1)).alias("n_rows"))


def near_constant(df: DataFrame, columns: list[str], share: float = 0.99, distinct: int = 10) -> DataFrame:
    """Most common value's share and number of values per column; two-level counts, so a constant column is no hot key.

    Values that are equal to six decimals count as one.
    """
    values = unpivoted(df, columns).withColumn("value", F.round("value", 6)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    out = values.groupBy("column").agg((F.max("n") / F.sum("n")).alias("top_share"), F.count("value").alias("n_values"))
    return out.withColumn("flagged", (F.col("top_share") >= share) | (F.col("n_values") <= distinct))


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for every pair of columns, pairwise complete, in one aggregate."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[_corr(F.col(a), F.col(b)).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)]))
    return one.select(rows.alias("x")).select("x.a", "x.b", "x.r")


def _corr(a: Column, b: Column) -> Column:
    return F.corr(F.when(b.isNotNull(), a.cast("double")), F.when(a.isNotNull(), b.cast("double")))


def spearman(df: DataFrame, column: str, others: list[str]) -> DataFrame:
    """(column, r, rho, gap) of each other column with ``column``: average ranks of pairwise complete rows.

    A value's rows are counted before the exchange, and no task ranks a whole column.
    """
    long = df.select(F.col(column).cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in others]).unpivot(["y"], others, "column", "x").filter("x IS NOT NULL AND y IS NOT NULL")
    rank = lambda c: average_ranks(long, ("column",), c, f"r{c}").drop("t")
    j = long.groupBy("column", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("n")).join(rank("x"), ["column", "x"]).join(rank("y"), ["column", "y"])

    def weighted(a: str, b: str) -> Column:
        n, sa, sb = F.sum("n"), F.sum(F.col("n") * F.col(a)), F.sum(F.col("n") * F.col(b))
        cov = F.sum(F.col("n") * F.col(a) * F.col(b)) - sa * sb / n
        va, vb = (F.sum(F.col("n") * F.col(k) * F.col(k)) - s * s / n for k, s in ((a, sa), (b, sb)))
        return F.try_divide(cov, F.nullif(F.sqrt(va * vb), F.lit(0.0)))

    out = j.groupBy("column").agg(weighted("rx", "ry").alias("rho"), weighted("x", "y").alias("r"))
    return out.withColumn("gap", F.abs(F.col("rho") - F.col("r")))


def strong_pairs(correlations: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Pairs of |r| at the threshold or above, and in how many of them each member stands."""
    strong = correlations.filter(F.abs(F.col("r")) >= threshold)
    ends = strong.select(F.explode(F.array("a", "b")).alias("column")).groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    of = lambda c: ends.select(F.col("column").alias(c), F.col("n").alias(f"pairs_of_{c}"))
    return strong.join(F.broadcast(of("a")), "a").join(F.broadcast(of("b")), "b")


def suggested_drops(pairs: list[tuple[str, str, float]], with_target: dict[str, float]) -> list[str]:
    """Of each pair, strongest first, the member less correlated with the target, unless one is dropped already."""
    gone: list[str] = []
    for a, b, _ in sorted(pairs, key=lambda p: (-abs(p[2]), p[0], p[1])):
        if a not in gone and b not in gone:
            gone.append(min((a, b), key=lambda c: (abs(with_target.get(c) or 0.0), c)))
    return gone


def user_differences(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Per user rows, mean, median, deviation; the spread between users over the spread within, and the rank of the mean."""
    u = df.groupBy(ID).agg(F.count(target).alias("n_rows"), F.avg(target).alias("mean"), median(F.col(target)).alias("median"), F.stddev_samp(target).alias("std"))
    ratio = u.agg(F.try_divide(F.stddev_samp("mean"), F.nullif(F.avg("std"), F.lit(0.0))).alias("between_within"))
    return u.join(F.broadcast(ratio), F.lit(True))


def top_users(users: DataFrame, n: int = 15) -> DataFrame:
    return users.orderBy(F.desc("mean"), ID).limit(n)


def outliers_iqr(df: DataFrame, columns: list[str], k: float = 1.5) -> DataFrame:
    """Bounds, count and percent outside k * IQR per column."""
    long = unpivoted(df, columns).filter("value IS NOT NULL")
    q = quantile_columns(long, "value", {"q1": 0.25, "q3": 0.75}, ("column",))
    q = q.select("column", (F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("low"), (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("high"))
    out = (F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))
    return long.join(F.broadcast(q), "column").groupBy("column", "low", "high").agg(F.count_if(out).alias("n_outside"), (100 * F.avg(out.cast("double"))).alias("percent_outside"))


def history_coverage(df: DataFrame, short: int = 4) -> DataFrame:
    """(months, users with so many months, whether that is short)."""
    u = df.groupBy(ID).agg(F.countDistinct(TIME).alias("n_months"))
    return u.groupBy("n_months").agg(F.count(F.lit(1)).alias("n_users")).withColumn("short", F.col("n_months") < short)


def users_by_month(df: DataFrame) -> DataFrame:
    return df.groupBy(TIME).agg(F.countDistinct(ID).alias("n_users"))


def transactions_by_month(df: DataFrame) -> DataFrame:
    """Totals shifted back to the month they belong to; the first month, which has none, drops out."""
    return df.groupBy(F.add_months(TIME, -1).alias(TIME)).agg(F.sum(COUNTS[0]).alias("n_transactions")).filter("n_transactions IS NOT NULL")


def longest_series(df: DataFrame, target: str = TARGET) -> DataFrame:
    """The target series of the user with the longest history (the smallest id of several)."""
    top = df.groupBy(ID).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), ID).limit(1)
    return df.join(F.broadcast(top), ID, "left_semi").select(ID, TIME, target).orderBy(TIME)


def table_profile(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per column its nulls in either table, and where it is missing."""

    def profile(df: DataFrame, side: str) -> DataFrame:
        one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
        return one.unpivot([], df.columns, "column", f"nulls_{side}")

    j = profile(a, "a").join(profile(b, "b"), "column", "full_outer")
    only = F.when(F.col("nulls_b").isNull(), "a").when(F.col("nulls_a").isNull(), "b").otherwise("both")
    return j.withColumn("present_in", only)
