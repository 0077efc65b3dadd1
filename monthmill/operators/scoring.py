"""Scores of predictions as grouped aggregates over (model, truth, prediction, anchor) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import finite, median, wape
from ..sources.panel import ID
from .ordered import quantile_columns, with_group

MAPE_FLOOR = 1000.0
TIERS = ("smb", "mid", "enterprise")


def _error() -> Column:
    return F.col("truth") - F.col("prediction")


def r2(error: Column, truth: Column) -> Column:
    """Aggregate: 1 - SSE / SST, null for a constant truth."""
    return 1 - F.try_divide(F.sum(error * error), F.nullif(F.var_pop(truth) * F.count(truth), F.lit(0.0)))


def measures(floor: float = MAPE_FLOOR) -> dict[str, Column]:
    """Every score of a group as an aggregate; rows are finite already."""
    e, y, p = _error(), F.col("truth"), F.col("prediction")
    size = F.abs(y) + F.abs(p)
    above = F.abs(y) >= floor
    moved = F.when(finite(F.col("anchor")), F.col("truth") - F.col("anchor"))
    moved_error = F.when(moved.isNotNull(), e)
    return {
        "n_rows": F.count(F.lit(1)),
        "mse": F.avg(e * e),
        "rmse": F.sqrt(F.avg(e * e)),
        "sme": F.avg(e),
        "mae": F.avg(F.abs(e)),
        "median_ae": median(F.abs(e)),
        "wape": wape(e, y),
        "smape": 100 * F.avg(F.when(size > 0, F.try_divide(2 * F.abs(e), size))),
        "mape": 100 * F.avg(F.when(above, F.try_divide(F.abs(e), F.abs(y)))),
        "mape_coverage": F.avg(above.cast("double")),
        "r2_level": r2(e, y),
        "r2_change": r2(moved_error, moved),
        "n_rows_change": F.count(moved),
        "mae_change": F.avg(F.abs(moved_error)),
        "rmse_change": F.sqrt(F.avg(moved_error * moved_error)),
        "wape_change": wape(moved_error, moved),
    }


def usable(pred: DataFrame) -> DataFrame:
    return pred.filter(finite(F.col("truth")) & finite(F.col("prediction")))


def score_all(pred: DataFrame, by: tuple[str, ...] = ("model",), only: tuple[str, ...] | None = None, floor: float = MAPE_FLOOR) -> DataFrame:
    """All (or the named) scores per group in one pass.

    The median takes two more passes where groups are few and may be large, that is, unless they are single users.
    """
    wanted = {k: v for k, v in measures(floor).items() if only is None or k in only}
    rows = usable(pred)
    if "median_ae" not in wanted or ID in by:
        return rows.groupBy(*by).agg(*[v.alias(k) for k, v in wanted.items()])
    others = rows.groupBy(*by).agg(*[v.alias(k) for k, v in wanted.items() if k != "median_ae"])
    middle = quantile_columns(rows.withColumn("_size", F.abs(_error())), "_size", {"median_ae": 0.5}, by)
    return with_group(others, middle, by).select(*by, *wanted)


def of_reference(column: str, reference: str, *by: str) -> Column:
    """The reference model's ``column`` beside every model of its group: a window over a row per model, so the scores are made once."""
    return F.max(F.when(F.col("model") == reference, F.col(column))).over(Window.partitionBy(*by or [F.lit(0)]))


def with_skill(scores: DataFrame, reference: str = "persistence", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``skill`` = 1 - rmse / the reference's rmse; null for the reference and where that is 0."""
    ref = F.nullif(of_reference("rmse", reference, *by), F.lit(0.0))
    return scores.withColumn("_ref", ref).withColumn("skill", F.when(F.col("model") != reference, 1 - F.try_divide("rmse", "_ref"))).drop("_ref")


def score_by_group(pred: DataFrame, group: str, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """n_rows, rmse, mae, median_ae and wape per group, null a group of its own."""
    return score_all(pred, (*by, group), ("n_rows", "rmse", "mae", "median_ae", "wape"))


#: Scores that are sums of a row's own numbers, so one reading serves groupings of any fineness.
MOMENTS = ("n_rows", "mse", "rmse", "sme", "mae", "wape", "smape", "mape", "r2_level")


def score_sets(pred: DataFrame, sets: dict[str, tuple[str, ...]], by: tuple[str, ...] = ("model",), only: tuple[str, ...] = MOMENTS) -> DataFrame:
    """(grouping, by..., the sets' columns, scores): all groupings from one reading; columns that a set lacks are null.

    Sums are combined before the exchange, whichever grouping a row's copies go to; medians, which can't be, aren't here.
    """
    columns = [*by, *dict.fromkeys(c for s in sets.values() for c in s)]
    grouped = usable(pred).groupingSets([[*by, *s] for s in sets.values()], *columns)
    # A bit of the grouping's number is set where it lacks the column, the first column's bit highest.
    lacks = lambda s: sum(1 << k for k, c in enumerate(reversed(columns)) if c not in (*by, *s))
    name = F.coalesce(*[F.when(F.grouping_id() == lacks(s), F.lit(n)) for n, s in sets.items()])
    return grouped.agg(name.alias("grouping"), *[v.alias(k) for k, v in measures().items() if k in only]).select("grouping", *columns, *only)


def assign_tiers(train: DataFrame, size: str, quantiles: tuple[float, float] = (0.5, 0.9), id: str = "user_id") -> DataFrame:
    """(id, tier) from each entity's median |size| on training rows."""
    typical = train.groupBy(id).agg(median(F.abs(F.col(size))).alias("typical")).filter("typical IS NOT NULL")
    cuts = quantile_columns(typical, "typical", dict(zip(("low", "high"), quantiles)))
    tier = F.when(F.col("typical") <= F.col("low"), TIERS[0]).when(F.col("typical") > F.col("high"), TIERS[2]).otherwise(TIERS[1])
    return typical.join(F.broadcast(cuts), F.lit(True)).select(id, "typical", tier.alias("tier"))


def score_by_tier(pred: DataFrame, tiers: DataFrame, id: str = "user_id") -> DataFrame:
    tagged = pred.join(tiers.select(id, "tier"), id, "left").withColumn("tier", F.coalesce("tier", F.lit("unassigned")))
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier")), F.lit(0)), F.lit(len(TIERS) + 1)).cast("long")
    return score_by_group(tagged, "tier").withColumn("tier_order", order)


def error_quantiles(pred: DataFrame, points=(50, 75, 90, 95, 99)) -> DataFrame:
    return quantile_columns(usable(pred).withColumn("_size", F.abs(_error())), "_size", {f"p{p}": p / 100 for p in points}, ("model",))


def worst_entities(pred: DataFrame, n: int = 10, id: str = "user_id") -> DataFrame:
    """The n entities of the largest rmse per model; ties go to the smaller id."""
    scored = score_by_group(pred, id)
    w = Window.partitionBy("model").orderBy(F.desc(F.round("rmse", 6)), id)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def top_error_share(pred: DataFrame, n: int = 10, id: str = "user_id") -> DataFrame:
    """Share of the total squared error that the worst n entities hold."""
    worst = worst_entities(pred, n, id).select("model", id, F.lit(1).alias("_top"))
    squared = usable(pred).groupBy("model", id).agg(F.sum(_error() * _error()).alias("se"))
    return squared.join(F.broadcast(worst), ["model", id], "left").groupBy("model").agg(
        F.try_divide(F.sum(F.when(F.col("_top") == 1, F.col("se"))), F.nullif(F.sum("se"), F.lit(0.0))).alias("top_share")
    )


METRICS = ("r2", "mae", "rmse", "wape")


def leaderboard(scores: DataFrame, rank_by: str = "wape") -> DataFrame:
    """(framing, model, r2, mae, rmse, wape, rank) in the amount and the movement framing; an unknown column falls back to wape."""
    rank_by = rank_by if rank_by in METRICS else "wape"
    amount = scores.select(F.lit("amount").alias("framing"), "model", F.col("r2_level").alias("r2"), "mae", "rmse", "wape")
    moved = scores.select(F.lit("movement").alias("framing"), "model", F.col("r2_change").alias("r2"), *[F.col(f"{c}_change").alias(c) for c in METRICS[1:]])
    key = F.col(rank_by).desc_nulls_last() if rank_by == "r2" else F.col(rank_by).asc_nulls_last()
    return amount.unionByName(moved).withColumn("rank", F.row_number().over(Window.partitionBy("framing").orderBy(key, "model")))


BOARD = ("rmse", "mae", "median_ae", "wape", "smape", "p90_ae", "sme", "r2_level", "r2_change", "mae_change", "rmse_change", "wape_change", "skill")


def comparison_table(pred: DataFrame, sort_by: str = "median_ae") -> DataFrame:
    """A row per model with thirteen measures, best first by ``rank``; an unknown column falls back to median_ae."""
    sort_by = sort_by if sort_by in BOARD else "median_ae"
    tail = error_quantiles(pred, (90,)).select("model", F.col("p90").alias("p90_ae"))
    scores = with_skill(score_all(pred)).join(tail, "model").select("model", *BOARD)
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col(sort_by).asc_nulls_last(), "model")))  # a row per model


def train_vs_test(train: DataFrame, test: DataFrame, reference: str = "persistence") -> DataFrame:
    """Per model the scores on both sides, gap = test / train MAE, skill and skill_mae against the reference."""
    both = ("mse", "rmse", "mae", "median_ae", "sme", "smape")
    t = with_skill(test, reference).withColumn("_ref", of_reference("mae", reference))
    joined = t.join(train.select("model", *[F.col(c).alias(f"train_{c}") for c in both]), "model", "left")
    return joined.select(
        "model",
        *[x for c in both for x in (F.col(f"train_{c}"), F.col(c).alias(f"test_{c}"))],
        F.try_divide("mae", F.nullif("train_mae", F.lit(0.0))).alias("gap"),
        F.col("wape").alias("test_wape"),
        F.col("wape_change").alias("test_wape_change"),
        F.col("r2_change").alias("test_r2_change"),
        "skill",
        (1 - F.try_divide("mae", F.nullif("_ref", F.lit(0.0)))).alias("skill_mae"),
    )


def grade(percent: Column) -> Column:
    return F.when(percent.isNull(), "n/a").when(percent < 10, "highly accurate").when(percent < 20, "good").when(percent < 50, "reasonable").otherwise("poor")


def train_vs_test_percent(train: DataFrame, test: DataFrame, reference: str = "persistence") -> DataFrame:
    """The same as percentages with a grade of the test WAPE."""
    fitted = train.select("model", F.col("wape").alias("train_wape"), F.col("mae").alias("train_mae"))
    j = test.withColumn("_ref", of_reference("mae", reference)).join(fitted, "model", "left")
    spread = F.try_divide("rmse", F.nullif("mae", F.lit(0.0)))
    return j.select(
        "model",
        "train_wape",
        F.col("wape").alias("test_wape"),
        (F.col("wape") * spread).alias("test_nrmse"),
        F.col("smape").alias("test_smape"),
        spread.alias("rmse_by_mae"),
        F.col("wape_change").alias("test_wape_change"),
        F.try_divide("mae", F.nullif("_ref", F.lit(0.0))).alias("mase"),
        "r2_change",
        (100 * (F.try_divide("mae", F.nullif("train_mae", F.lit(0.0))) - 1)).alias("gap_percent"),
        grade(F.col("wape")).alias("grade"),
    )


def compare_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """One table of several, tagged by their names."""
    out = None
    for name, df in tables.items():
        tagged = df.select(F.lit(name).alias("table_name"), "*")
        out = tagged if out is None else out.unionByName(tagged)
    return out


def cv_summary(fold_scores: DataFrame, columns: tuple[str, ...] = ("mae", "rmse", "wape", "wape_change")) -> DataFrame:
    """Means over folds per model, the sample deviation of wape, the number of folds."""
    return fold_scores.groupBy("model").agg(*[F.avg(c).alias(c) for c in columns], F.stddev_samp("wape").alias("wape_std"), F.count("fold").alias("folds"))


def segment_fold_wape(pred: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(fold, model, segmentation, segment, n_rows, wape): one pass over rows unpivoted by segmentation."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("segmentation"), F.col(c).alias("segment")) for c in columns]))
    long = pred.select("fold", "model", "truth", "prediction", each.alias("s")).select("*", "s.segmentation", "s.segment")
    return score_all(long, ("fold", "model", "segmentation", "segment"), ("n_rows", "wape"))


def segment_cv_summary(fold_wape: DataFrame, labels: DataFrame, reference: str = "persistence", min_won: int = 4, min_rows: int = 100) -> DataFrame:
    """Each model against the reference per segment over the folds."""
    beside = fold_wape.withColumn("ref", of_reference("wape", reference, "segmentation", "segment", "fold"))
    others = beside.filter(F.col("model") != reference).withColumn("won", F.coalesce(F.col("wape") < F.col("ref"), F.lit(False)))
    out = others.groupBy("segmentation", "segment", "model").agg(
        F.avg("n_rows").alias("rows_per_fold"), F.avg("ref").alias("reference_wape"), F.avg("wape").alias("wape"), F.count_if("won").alias("folds_won"), F.count("fold").alias("folds")
    )
    out = out.withColumn("gain", F.col("reference_wape") - F.col("wape"))
    passes = F.coalesce((F.col("gain") > 0) & (F.col("folds_won") >= min_won) & (F.col("rows_per_fold") >= min_rows), F.lit(False))
    out = out.withColumn("passes", passes).join(F.broadcast(labels), ["segmentation", "segment"], "left")
    return out.withColumn("category", F.coalesce("category", F.col("segment").cast("string")))
