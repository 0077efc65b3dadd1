"""Typing, validation, projection and row selection of panels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import median
from ..sources.panel import ID, TARGET, TIME, Panel
from ..sources.tables import kept
from .ordered import sum_before
from .splits import cut_positions, month_ranks


class PanelError(ValueError):
    """The panel breaks a rule."""


def coerce_types(df: DataFrame, renames: dict[str, str] | None = None, id: str = ID, time: str = TIME, strict: bool = True) -> DataFrame:
    """Source renames, months to their first day, other columns to double.

    Raises on a rename onto an existing column and, if ``strict``, on months that can't be read.
    """
    renames = renames or {}
    clash = [new for old, new in renames.items() if old in df.columns and new in df.columns]
    if clash:
        raise PanelError(f"renaming onto existing columns {clash}")
    df = df.withColumnsRenamed({k: v for k, v in renames.items() if k in df.columns})
    month = F.trunc(F.col(time).try_cast("date"), "month")
    out = df.select(
        F.col(id).cast("string").alias(id), month.alias(time), *[F.nanvl(F.col(c).try_cast("double"), F.lit(None)).alias(c) for c in df.columns if c not in (id, time)]
    )
    if strict and (bad := df.filter(F.col(time).isNotNull() & month.isNull()).count()):
        raise PanelError(f"{bad} months can't be read")
    return out


def duplicate_keys(df: DataFrame, id: str = ID, time: str = TIME) -> DataFrame:
    """(id, time, n) of keys that stand more than once."""
    return df.groupBy(id, time).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def validation_report(df: DataFrame, required: Iterable[str] = (ID, TIME, TARGET), id: str = ID, time: str = TIME) -> DataFrame:
    """One row: n_rows, n_missing_columns, n_null_months, n_duplicate_keys, is_valid."""
    missing = [c for c in required if c not in df.columns]
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(time).isNull()).alias("n_null_months"))
    twice = duplicate_keys(df, id, time).agg(F.count(F.lit(1)).alias("n_duplicate_keys"))
    out = counts.crossJoin(F.broadcast(twice)).withColumn("n_missing_columns", F.lit(len(missing)).cast("long"))  # one row each
    valid = (F.col("n_missing_columns") == 0) & (F.col("n_rows") > 0) & (F.col("n_null_months") < F.col("n_rows")) & (F.col("n_duplicate_keys") == 0)
    return out.withColumn("is_valid", valid)


def validate_panel(df: DataFrame, required: Iterable[str] = (ID, TIME, TARGET), id: str = ID, time: str = TIME) -> DataFrame:
    """``df`` itself, or an error that counts what is wrong and shows examples."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise PanelError(f"missing columns {missing}")
    r = validation_report(df, required, id, time).first()
    if not r.is_valid:
        examples = [tuple(x)[:2] for x in duplicate_keys(df, id, time).limit(5).collect()]
        raise PanelError(f"{r.n_rows} rows, {r.n_null_months} without a month, {r.n_duplicate_keys} keys twice, such as {examples}")
    return df


def drop_missing_target(df: DataFrame, target: str = TARGET, strict: bool = False) -> DataFrame:
    kept = df.filter(F.col(target).isNotNull())
    if strict and kept.isEmpty():
        raise PanelError("no row has a target")
    return kept


def select_features(df: DataFrame, features: Iterable[str] = (), drop: Iterable[str] = (), id: str = ID, time: str = TIME, target: str = TARGET) -> Panel:
    """Feature projection: an exact list, else all columns but the roles and the dropped ones."""
    roles, features = (id, time, target), tuple(features)
    wrong = [c for c in features if c in roles or c not in df.columns]
    if wrong:
        raise PanelError(f"not usable as features: {wrong}")
    dropped = set(drop)
    chosen = features or tuple(c for c in df.columns if c not in roles and c not in dropped)
    return Panel(df, id, time, target, chosen)


def take_months(df: DataFrame, months: DataFrame, time: str = TIME) -> DataFrame:
    """Rows whose month is listed; both sides count from the month's first day."""
    listed = months.select(F.trunc(F.col(time), "month").alias("_m")).distinct()
    return df.join(listed, F.trunc(F.col(time), "month") == F.col("_m"), "left_semi")


def panel_summary(panel: Panel) -> DataFrame:
    return panel.df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(panel.id).alias("n_entities"),
        F.countDistinct(panel.time).alias("n_months"),
        F.min(panel.time).alias("first_month"),
        F.max(panel.time).alias("last_month"),
        F.lit(len(panel.features)).cast("long").alias("n_features"),
    )


def distinct_months(df: DataFrame, time: str = TIME) -> DataFrame:
    return df.select(time).distinct().orderBy(time)


def null_shares(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """(column, share of nulls), one pass."""
    columns = list(columns or df.columns)
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return one.unpivot([], columns, "column", "null_share")


def trim_whales(df: DataFrame, size: str, share: float, test_share: float = 0.2, gap: int = 0, id: str = ID, time: str = TIME) -> DataFrame:
    """Without the floor(n * share) entities of the largest median |size| over training months; of equal ones the smaller id goes first.

    Entities without a size stay.  Equal sizes are counted first, and only the entities of the last size that goes are ranked.
    """
    if not 0 <= share < 1:
        raise PanelError(f"the share must be in [0, 1), not {share}")
    ranks = month_ranks(df, time)
    train_end, _ = cut_positions(ranks.count(), test_share, gap)
    seen = df.join(F.broadcast(ranks.filter(F.col("rank") <= train_end).select(time)), time, "left_semi")  # months are few
    sizes = kept(seen.groupBy(id).agg(median(F.abs(F.col(size))).alias("_size")).filter("_size IS NOT NULL"))
    counts = sizes.groupBy((-F.col("_size")).alias("_down")).agg(F.count(F.lit(1)).alias("_equal"))
    go = counts.agg(F.floor(F.sum("_equal") * share + 1e-9).alias("_go"))
    cut = sum_before(counts, (), "_down", "_equal", "_larger").join(F.broadcast(go), F.col("_larger") < F.col("_go"))  # one row
    gone = sizes.withColumn("_down", -F.col("_size")).join(cut, "_down")
    whole = F.col("_larger") + F.col("_equal") <= F.col("_go")
    last = gone.filter(~whole).withColumn("_n", F.row_number().over(Window.partitionBy("_down").orderBy(id))).filter(F.col("_larger") + F.col("_n") <= F.col("_go"))
    return df.join(gone.filter(whole).select(id).union(last.select(id)), id, "left_anti")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (n_rows, digest) that changes with any value or column name, but not with the order of rows."""
    columns = sorted(df.columns)
    row = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]).cast("binary"))
    half = lambda at: F.sum(F.conv(F.substring(row, at, 8), 16, 10).cast("decimal(20,0)"))
    sums = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.coalesce(half(at), F.lit(0)).cast("decimal(38,0)").alias(f"h{at}") for at in (1, 9, 17, 25)])
    text = F.concat_ws("|", F.lit(",".join(columns)), "n_rows", *[F.col(f"h{at}").cast("string") for at in (1, 9, 17, 25)])
    return sums.select("n_rows", F.md5(text.cast("binary")).alias("digest"))


def latest_rows(df: DataFrame, id: str = ID, time: str = TIME) -> DataFrame:
    """Each entity's last row."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(id).orderBy(F.desc(time)))).filter("_n = 1").drop("_n")
