"""Scenario slices and paired, user-level comparison of two models."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.panel import CREDITED, ID, LAGS, TIME
from ..sources.tables import kept
from .ordered import sum_before

DRAWS, SEED = 2000, 42
#: Places of a draw that are made at once.
BLOCK = 4096


def scenarios() -> dict[str, Column]:
    return {
        "all_rows": F.col("truth").isNotNull(),
        "dynamic_overdraft": F.col("sign_flips_6m") >= 2,
        "zero_income": F.col(CREDITED) == 0,
        "gig_income": F.col("income_cv_6m") >= 1.0,
    }


def slice_rows(rows: DataFrame) -> DataFrame:
    """Each row once for every scenario that it belongs to."""
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in scenarios().items()]), lambda x: x.isNotNull())
    return rows.withColumn("scenario", F.explode(names))


def alignment(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: keys in both, only in one, and with different truths."""
    j = a.select(ID, TIME, F.col("truth").alias("ta"), F.lit(1).alias("a")).join(b.select(ID, TIME, F.col("truth").alias("tb"), F.lit(1).alias("b")), [ID, TIME], "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return j.agg(
        F.count_if(both).alias("in_both"),
        F.count_if(F.col("b").isNull()).alias("only_first"),
        F.count_if(F.col("a").isNull()).alias("only_second"),
        F.count_if(both & ~F.col("ta").eqNullSafe(F.col("tb"))).alias("truth_differs"),
    )


PAIR = ("champion", "challenger")


def of_pairs(rows: DataFrame, pairs: tuple[tuple[str, str], ...]) -> DataFrame:
    """Each row once per (champion, challenger) pair of prediction columns, with both errors; rows need ``truth``."""
    error = lambda c: F.abs(F.col("truth") - F.col(c))
    each = F.array(*[F.struct(F.lit(a).alias("champion"), F.lit(b).alias("challenger"), error(a).alias("ea"), error(b).alias("eb")) for a, b in pairs])
    models = {m for pair in pairs for m in pair}
    return rows.withColumn("p", F.explode(each)).select(*[c for c in rows.columns if c not in models | set(PAIR)], "p.*")


def per_user(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Sum, number and mean of the challenger's less the champion's error, and both sums, per pair and user."""
    more = F.col("eb") - F.col("ea")
    return rows.groupBy(*by, *PAIR, ID).agg(
        F.sum(more).alias("diff_sum"), F.count(F.lit(1)).alias("n"), F.avg(more).alias("diff_mean"), F.sum("ea").alias("champion_sum"), F.sum("eb").alias("challenger_sum")
    )


def numbered(users: DataFrame, by: tuple[str, ...], name: str = "no") -> DataFrame:
    """Users of a group numbered from 0 in order of the first three digits of their md5, then of themselves.

    No task numbers a whole group: a digit triple is a window of its own, and the 4,096
    counts of a group give what lies before it.
    """
    dealt = users.withColumn("_digits", F.substring(F.md5(F.col(ID).cast("string").cast("binary")), 1, 3))
    counts = dealt.groupBy(*by, "_digits").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*by).orderBy("_digits") if by else Window.partitionBy(F.lit(0)).orderBy("_digits")
    counts = counts.select(*by, "_digits", (F.sum("_n").over(ahead.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy(*by, "_digits").orderBy(ID))
    return dealt.join(F.broadcast(counts), [*by, "_digits"]).withColumn(name, F.col("_ahead") + inside - 1).drop("_digits", "_ahead")


def _picks(keys: list[str], seed: int) -> Callable:
    """Rows of (keys..., no) of blocks of places, a batch for each: the first 32 bits of an md5 of (draw, place, seed), modulo the group's users."""

    def of_blocks(batches):
        for batch in batches:
            for k, (draw, first, last, users) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("draw", "from", "to", "users")])):
                digests = b"".join([md5(b"%d|%d|%d" % (draw, place, seed)).digest()[:4] for place in range(first, last + 1)])
                no = np.frombuffer(digests, ">u4").astype(np.int64) % users
                group = batch.select(keys).take(pa.array(np.full(len(no), k)))
                yield pa.RecordBatch.from_arrays([*group.columns, pa.array(no)], names=[*keys, "no"])

    return of_blocks


def bootstrap_ci(users: DataFrame, by: tuple[str, ...] = (), draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """2.5 % and 97.5 % quantiles of the mean difference over draws of whole users, per group and pair.

    A draw takes as many users as a group has; the k-th is picked by an md5 of (draw, k, seed),
    so it is the same everywhere, and for all pairs.  Picks are made by draw and block of places, whatever the number
    of partitions that the users come in, and look up users that are dealt by number.  Picks are never broadcast, though
    the optimizer sees only the draws that they come from; a draw's sums are combined before the exchange.
    """
    sums = F.map_from_entries(F.collect_list(F.struct(F.struct(*PAIR), F.struct("diff_sum", "n"))))
    own = kept(numbered(users.groupBy(*by, ID).agg(sums.alias("sums")), by))
    sized = own.groupBy(*by).agg(F.count(F.lit(1)).alias("users"))
    spark = users.sparkSession
    parts = min(draws, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    each = spark.range(0, draws, 1, parts).select(F.col("id").cast("int").alias("draw")).join(F.broadcast(sized.filter("users > 0")), F.lit(True))  # a row per group
    blocks = each.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("users") - 1, F.lit(BLOCK).cast("long"))))
    blocks = blocks.withColumn("to", F.least(F.col("from") + (BLOCK - 1), F.col("users") - 1))
    keys = [*by, "draw"]
    picked = blocks.mapInArrow(_picks(keys, seed), StructType([*[blocks.schema[c] for c in keys], StructField("no", LongType())]))
    drawn = picked.join(own.select(*by, "no", "sums").hint("shuffle_hash"), [*by, "no"]).select(*by, "draw", F.explode("sums").alias("pair", "x"))
    means = drawn.groupBy(*by, "draw", "pair").agg((F.sum("x.diff_sum") / F.sum("x.n")).alias("mean"))
    return means.groupBy(*by, "pair.champion", "pair.challenger").agg(F.percentile("mean", 0.025).alias("ci_low"), F.percentile("mean", 0.975).alias("ci_high"))


#: Coefficients of the complementary error function by Abramowitz and Stegun 7.1.26 (fixed values); off by at most 1.5e-7.
ERFC = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERFC_AT = 0.3275911


def two_sided_p(z: Column) -> Column:
    """2 * Phi(-|z|)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + ERFC_AT * x)
    return sum((c * F.pow(t, F.lit(k)) for k, c in enumerate(ERFC, 1)), F.lit(0.0)) * F.exp(-x * x)


#: Up to so many users without ties the signed ranks' own distribution is used.
EXACT_USERS = 50


def exact_two_sided_p(n: Column, w: Column) -> Column:
    """2 * P(W <= w), at most 1, for the sum W of a random subset of the ranks 1 to n.

    The number of subsets of each sum: a rank either is in the subset, which shifts the counts by it, or isn't.  Counts
    up to 2^50 are exact in doubles.
    """
    zeros = lambda k: F.array_repeat(F.lit(0.0), k)
    with_rank = lambda counts, r: F.zip_with(F.concat(counts, zeros(r)), F.concat(zeros(r), counts), lambda a, b: a + b)
    counts = F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.array(F.lit(1.0)), with_rank)
    below = F.aggregate(F.slice(counts, F.lit(1), F.floor(w).cast("int") + 1), F.lit(0.0), lambda a, b: a + b)
    return F.least(F.lit(1.0), 2 * below / F.pow(F.lit(2.0), n))


def wilcoxon(users: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Signed ranks of the users' means: zeros dropped, average ranks, tie-corrected normal approximation.

    p_normal is the approximation's, p_exact that of the ranks' own distribution, null above EXACT_USERS or with ties;
    p_value is the exact one where there is one.
    """
    d = users.select(*by, F.round("diff_mean", 6).alias("d")).filter("d <> 0").withColumn("s", F.abs("d"))
    # Ranks come from counts per distinct size, so equal sizes are one row.
    ups = d.groupBy(*by, "s").agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("d") > 0).alias("up"))
    ranked = sum_before(ups, by, "s", "t", "before").withColumn("rank", F.col("before") + (F.col("t") + 1) / 2.0)
    t = F.col("t").cast("double")
    sums = ranked.groupBy(*by).agg(
        F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * (F.col("t") - F.col("up"))).alias("w_minus"), F.sum("t").alias("n"), F.sum(t * t * t - t).alias("ties")
    )
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    z = F.try_divide(F.least("w_plus", "w_minus") - n * (n + 1) / 4, F.nullif(spread, F.lit(0.0)))
    few = (F.col("n") <= EXACT_USERS) & (F.col("ties") == 0)
    out = sums.withColumn("z", z).withColumns({"p_normal": two_sided_p(F.col("z")), "p_exact": F.when(few, exact_two_sided_p(F.col("n"), F.least("w_plus", "w_minus")))})
    return out.withColumn("p_value", F.coalesce("p_exact", "p_normal")).drop("ties")


def verdict(low: Column, high: Column) -> Column:
    return F.when(high < 0, "challenger better").when(low > 0, "champion better").otherwise("no difference")


def report(rows: DataFrame, pairs: tuple[tuple[str, str], ...], by: tuple[str, ...] = ("scenario",), draws: int = DRAWS) -> DataFrame:
    """Sizes, both MAEs, their change in percent, the interval, the p-value and the verdict per group and pair of models."""
    users = kept(per_user(of_pairs(rows, pairs), by))
    keys = [*by, *PAIR]
    totals = users.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_users"),
        (F.sum("champion_sum") / F.sum("n")).alias("champion_mae"), (F.sum("challenger_sum") / F.sum("n")).alias("challenger_mae"),
    )
    change = 100 * F.try_divide(F.col("challenger_mae") - F.col("champion_mae"), F.nullif("champion_mae", F.lit(0.0)))
    joined = totals.join(bootstrap_ci(users, by, draws), keys).join(wilcoxon(users, tuple(keys)).select(*keys, "z", "p_value"), keys, "left")
    return joined.withColumns({"mae_change_pct": change, "verdict": verdict(F.round("ci_low", 6), F.round("ci_high", 6))})


def fallback(rows: DataFrame, training_median: DataFrame) -> DataFrame:
    """Last known balance without last month's: two months back, three, else the training median."""
    return rows.join(F.broadcast(training_median), F.lit(True)).withColumn("fallback", F.coalesce(LAGS[1], LAGS[2], "median_target"))
