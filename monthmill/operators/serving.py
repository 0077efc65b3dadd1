"""Incremental serving: checkpoints, predictions, live errors, health, promotion.

Every step is safe to repeat: rows that exist are skipped by an anti-join and
checkpoints only move forward, so predictions are written before checkpoints and a
crash in between costs a repeated step, not a wrong one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import wape
from ..sources.panel import ID, LAST, TARGET, TIME
from .ordered import median_row

KEYS = [ID, TIME]


def pending_rows(panel: DataFrame, checkpoints: DataFrame, floor: DataFrame) -> DataFrame:
    """Rows after their user's checkpoint, or after the floor (one row) where there is none; the target may be missing."""
    seen = checkpoints.select(ID, F.col("last_month").alias("_last"))
    joined = panel.join(seen, ID, "left").join(F.broadcast(floor), F.lit(True))
    return joined.filter(F.col(TIME) > F.coalesce("_last", "floor_month")).drop("_last", "floor_month")


def route(no_model: tuple[int, ...] = (0,)) -> Column:
    """skip without last month's balance, persistence for the listed history ids, else model."""
    return F.when(F.col(LAST).isNull(), "skip").when(F.col("history_id").isin(*no_model), "persistence").otherwise("model")


def routed_predictions(rows: DataFrame, model: str, persistence: str) -> DataFrame:
    """``prediction`` by route; skipped rows have none."""
    chosen = F.when(F.col("route") == "model", F.col(model)).when(F.col("route") == "persistence", F.col(persistence))
    return rows.withColumn("prediction", chosen)


def insert_new(existing: DataFrame, new: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """``existing`` and those rows of ``new`` whose keys aren't there."""
    return existing.unionByName(new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti").select(*existing.columns))


def advance_checkpoints(checkpoints: DataFrame, rows: DataFrame) -> DataFrame:
    """The later of the old and the new month per user; skipped rows count."""
    moved = checkpoints.select(ID, "last_month").unionByName(rows.select(ID, F.col(TIME).alias("last_month")))
    return moved.groupBy(ID).agg(F.max("last_month").alias("last_month"))


def serve_outcome(rows: DataFrame) -> DataFrame:
    return rows.groupBy(ID).agg(F.count_if(F.col("route") != "skip").alias("predicted"), F.count_if(F.col("route") == "skip").alias("skipped"))


def resolve_live(predictions: DataFrame, panel: DataFrame, live: DataFrame) -> DataFrame:
    """``live`` and the predictions whose actual is known by now; error = prediction - actual."""
    known = panel.filter(F.col(TARGET).isNotNull()).select(*KEYS, F.col(TARGET).alias("actual"))
    new = predictions.join(known, KEYS).withColumn("error", F.col("prediction") - F.col("actual"))
    return insert_new(live, new.select(*live.columns))


def live_errors(live: DataFrame, predictions: DataFrame, version: str, route: str | None = None, since=None) -> DataFrame:
    """Resolved rows of a version with their route, optionally of one route or from a month on."""
    out = live.filter(F.col("model_version") == version).join(predictions.select(*KEYS, "route"), KEYS)
    if route is not None:
        out = out.filter(F.col("route") == route)
    if since is not None:
        out = out.filter(F.col(TIME) >= F.lit(since))
    return out


def live_scores(errors: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """mae, rmse, wape and n from stored errors; null when empty."""
    e = F.col("error")
    return errors.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), wape(e, F.col("actual")).alias("wape"), F.count(F.lit(1)).alias("n_rows"))


def recent_window(errors: DataFrame, months: int = 3) -> DataFrame:
    """The last calendar months up to the latest resolved one."""
    start = errors.agg(F.add_months(F.max(TIME), -(months - 1)).alias("_start"))
    return errors.join(F.broadcast(start), F.col(TIME) >= F.col("_start")).drop("_start")


def health_check(errors: DataFrame, baseline: DataFrame, now: Column, months: int = 3, min_rows: int = 30, decay: float = 0.10, cooldown_days: int = 3) -> DataFrame:
    """One row: live scores of the recent months against the holdout MAE, and whether and why to retrain.

    ``baseline``: one row of baseline_mae and last_trained (may be null).  The cooldown is a span between instants; a date is its midnight.
    """
    live = live_scores(recent_window(errors, months))
    j = live.join(F.broadcast(baseline), F.lit(True))
    j = j.withColumn("decay", F.when((F.col("n_rows") > 0) & (F.col("baseline_mae") > 0), F.col("mae") / F.col("baseline_mae") - 1))
    instant = lambda c: F.unix_micros(c.cast("timestamp"))
    resting = F.coalesce(instant(now) - instant(F.col("last_trained")) < cooldown_days * 86_400_000_000, F.lit(False))
    reason = (
        F.when(F.col("n_rows") < min_rows, "too_few_rows").when(F.coalesce(F.col("decay") <= decay, F.lit(False)), "within_tolerance").when(resting, "cooldown").otherwise("decayed")
    )
    return j.withColumn("reason", reason).withColumn("retrain", F.col("reason") == "decayed")


def relative_change(new: Column, old: Column) -> Column:
    """(new - old) / old, infinite where the old value isn't positive."""
    return F.when(old > 0, F.try_divide(new - old, old)).otherwise(F.lit(float("inf")))


def promotion_decision(scores: DataFrame, min_rows: int = 30, min_gain: float = 0.02, max_loss: float = 0.05) -> DataFrame:
    """``scores``: rows of basis, challenger_* and champion_* mae, rmse, wape, and champion_rows (null: no champion)."""
    mae, rmse, wape_ = (relative_change(F.col(f"challenger_{m}"), F.col(f"champion_{m}")) for m in ("mae", "rmse", "wape"))
    outcome = (
        F.when(F.col("champion_rows").isNull(), "promote")
        .when(F.col("champion_rows") < min_rows, "insufficient_data")
        .when(-mae < min_gain, "reject")
        .when((rmse > max_loss) | (wape_ > max_loss), "reject")
        .otherwise("promote")
    )
    basis = F.when(F.col("champion_rows").isNull(), "first_run").otherwise(F.col("basis"))
    return scores.withColumns({"outcome": outcome, "basis": basis})


def promotion_basis(live: DataFrame, holdout: DataFrame, min_rows: int = 30) -> DataFrame:
    """The champion's live scores if there are enough rows, else both on holdout months; one row each side."""
    l = live.select(*[F.col(c).alias(f"l_{c}") for c in ("challenger_mae", "challenger_rmse", "challenger_wape", "champion_mae", "champion_rmse", "champion_wape", "champion_rows")])
    j = holdout.join(F.broadcast(l), F.lit(True), "left")
    enough = F.coalesce(F.col("l_champion_rows") >= min_rows, F.lit(False))
    pick = [F.when(enough, F.col(f"l_{c}")).otherwise(F.col(c)).alias(c) for c in holdout.columns]
    return j.select(*pick, F.when(enough, "live").otherwise("holdout").alias("basis"))


def scores_on_route(rows: DataFrame, wanted: str = "model") -> DataFrame:
    """mae, rmse and wape of routed rows with a known target."""
    kept = rows.filter((F.col("route") == wanted) & F.col("truth").isNotNull() & F.col("prediction").isNotNull())
    return live_scores(kept.select((F.col("prediction") - F.col("truth")).alias("error"), F.col("truth").alias("actual")))


def save_performance(table: DataFrame, new: DataFrame, promoted: str | None = None, at: Column | None = None) -> DataFrame:
    """Inserts absent (version, split) scores; stamps a promoted version once."""
    out = insert_new(table, new, ["model_version", "split"])
    if promoted is not None:
        stamp = F.when(F.col("promoted_at").isNull() & (F.col("model_version") == promoted), at).otherwise(F.col("promoted_at"))
        out = out.withColumn("promoted_at", stamp)
    return out


def next_month_panel(panel: DataFrame, full_months: int = 6) -> DataFrame:
    """The next month's rows of users active in the latest month: shifted lags and window statistics, no target."""
    latest = panel.agg(F.max(TIME).alias("_latest"))
    by_time = Window.partitionBy(ID).orderBy(TIME)
    recent = lambda k: by_time.rowsBetween(-(k - 1), 0)
    b = F.col(TARGET)
    enough = lambda k, c: F.when(F.count(F.lit(1)).over(recent(k)) == k, c.over(recent(k)))
    everything = Window.partitionBy(ID)
    rows = panel.select(ID, TIME, TARGET).withColumns({"_lag1": F.lag(b, 1).over(by_time), "_lag2": F.lag(b, 2).over(by_time)})
    rows = rows.withColumns(
        {
            "roll3_mean_closing_balance_usd": enough(3, F.avg(b)),
            "roll3_std_closing_balance_usd": enough(3, F.stddev_samp(b)),
            "roll6_mean_balance": enough(6, F.avg(b)),
            "roll6_std_balance": enough(6, F.stddev_samp(b)),
            "share_neg_last_6m": enough(6, F.avg((b < 0).cast("double"))),
            "_n": F.count(F.lit(1)).over(everything),
            "_step": F.stddev_samp(b - F.col("_lag1")).over(everything),
        }
    )
    typical = rows.groupBy(ID).agg(F.first("_step").alias("s")).agg(F.percentile("s", 0.5).alias("typical_step"))
    active = rows.join(F.broadcast(latest), F.col(TIME) == F.col("_latest")).join(F.broadcast(typical), F.lit(True))
    return active.select(
        ID,
        F.add_months(TIME, 1).alias(TIME),
        b.alias("prev_1m_closing_balance_usd"),
        F.col("_lag1").alias("prev_2m_closing_balance_usd"),
        F.col("_lag2").alias("prev_3m_closing_balance_usd"),
        (b - F.col("_lag1")).alias("prev_1m_change"),
        "roll3_mean_closing_balance_usd", "roll3_std_closing_balance_usd", "roll6_mean_balance", "roll6_std_balance", "share_neg_last_6m",
        F.when(F.col("_n") >= full_months, 2).otherwise(1).alias("history_id"),
        F.coalesce(F.when(F.col("_n") >= 3, F.col("_step")), "typical_step").alias("step"),
    )


#: Balances that a carry holds.
TAIL = 6
CARRY = f"{ID} string, through date, n long, tail array<double>, steps long, step_mean double, step_m2 double"


def _with_moments(df: DataFrame, values: Column, name: str) -> DataFrame:
    """``df`` with the number, mean and sum of squares about it of an array's known values, 0 without any, as ``name`` and _k, _mean, _m2.

    Each is a column before the next one reads it: inside the last one's lambda a mean would be made again for every value.
    """
    known, mean = F.col(f"{name}_known"), F.col(f"{name}_mean")
    df = df.withColumn(f"{name}_known", F.filter(values, lambda x: x.isNotNull()))
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    df = df.withColumns({f"{name}_k": F.size(known).cast("long"), f"{name}_mean": F.coalesce(F.try_divide(total, F.size(known)), F.lit(0.0))})
    return df.withColumn(f"{name}_m2", F.aggregate(known, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))).drop(f"{name}_known")


def carry_forward(carry: DataFrame, rows: DataFrame) -> DataFrame:
    """``carry``, a row per user, moved on by the panel rows of later months.

    It holds what the next month needs of a history: the last months' balances, the number of months, and the
    moments of all monthly steps, which merge.  So serving reads the carry and the months since, never the
    history; months that the carry knows are left out, so a repeated step changes nothing.
    """
    new = rows.groupBy(ID).agg(F.array_sort(F.collect_list(F.struct(F.col(TIME).alias("t"), F.col(TARGET).alias("b")))).alias("_new"))
    j = carry.join(new, ID, "full_outer")
    later = F.filter("_new", lambda x: F.col("through").isNull() | (x.t > F.col("through")))
    none = F.array().cast("array<double>")
    j = j.withColumns({"_new": F.coalesce(later, F.array().cast("array<struct<t:date,b:double>>")), "_tail": F.coalesce("tail", none)})
    j = j.withColumn("_all", F.concat("_tail", F.transform("_new", lambda x: x.b)))
    # An index below 0 has no balance, so a user's first month has no step.
    j = j.withColumn("_made", F.transform("_new", lambda x, i: x.b - F.get("_all", F.size("_tail") + i - 1)))
    j = _with_moments(j, F.col("_made"), "").withColumns({"_k0": F.coalesce("steps", F.lit(0)), "_mean0": F.coalesce("step_mean", F.lit(0.0))})
    both, apart = F.nullif(F.col("_k") + F.col("_k0"), F.lit(0)), F.col("_mean") - F.col("_mean0")
    return j.select(
        ID,
        F.coalesce(F.get("_new", F.size("_new") - 1).t, "through").alias("through"),
        (F.coalesce("n", F.lit(0)) + F.size("_new")).alias("n"),
        F.slice("_all", F.greatest(F.size("_all") - (TAIL - 1), F.lit(1)), TAIL).alias("tail"),
        (F.col("_k") + F.col("_k0")).alias("steps"),
        (F.col("_mean0") + F.coalesce(apart * F.col("_k") / both, F.lit(0.0))).alias("step_mean"),
        (F.coalesce("step_m2", F.lit(0.0)) + F.col("_m2") + F.coalesce(apart * apart * F.col("_k") * F.col("_k0") / both, F.lit(0.0))).alias("step_m2"),
    )


def next_month_from_carry(carry: DataFrame, full_months: int = 6) -> DataFrame:
    """``next_month_panel`` from the carry alone."""
    latest = carry.agg(F.max("through").alias("_latest"))
    own = carry.withColumn("_step", F.sqrt(F.try_divide("step_m2", F.nullif(F.greatest(F.col("steps") - 1, F.lit(0)), F.lit(0)))))
    active = own.join(F.broadcast(latest), F.col("through") == F.col("_latest")).join(F.broadcast(median_row(own, F.col("_step"), "typical_step")), F.lit(True))
    back = lambda k: F.get("tail", F.size("tail") - k)
    last = lambda k: F.slice("tail", F.greatest(F.size("tail") - (k - 1), F.lit(1)), k)
    made = {}
    for k, name in ((3, "roll3_{}_closing_balance_usd"), (6, "roll6_{}_balance")):
        active = _with_moments(active, last(k), f"_last{k}")
        known = F.col(f"_last{k}_k")
        made[name.format("mean")] = F.when((F.col("n") >= k) & (known > 0), F.col(f"_last{k}_mean"))
        made[name.format("std")] = F.when((F.col("n") >= k) & (known > 1), F.sqrt(F.try_divide(f"_last{k}_m2", known - 1)))
    active = _with_moments(active, F.transform(last(6), lambda b: (b < 0).cast("double")), "_negative")
    made["share_neg_last_6m"] = F.when((F.col("n") >= 6) & (F.col("_negative_k") > 0), F.col("_negative_mean"))
    return active.select(
        ID,
        F.add_months("through", 1).alias(TIME),
        *[back(k).alias(f"prev_{k}m_closing_balance_usd") for k in (1, 2, 3)],
        (back(1) - back(2)).alias("prev_1m_change"),
        *[c.alias(name) for name, c in made.items()],
        F.when(F.col("n") >= full_months, 2).otherwise(1).alias("history_id"),
        F.coalesce(F.when(F.col("n") >= 3, F.col("_step")), "typical_step").alias("step"),
    )
