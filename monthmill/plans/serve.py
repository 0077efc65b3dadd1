"""Incremental serving and monitoring.

The state is derived from the supplier panel: the floor is the last training month,
three of four suppliers have a checkpoint up to two months later, and every fifth
supplier's pending months are predicted already.  The actuals of the last month are hidden.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scoring, serving
from ..sources.panel import ID, LAGS, TARGET, TIME, supplier_panel
from ..sources.tables import kept, overwrite, scratch_path
from .base import query
from .frames import BASELINES, baselines, predictions, segmented, sided
from .sql import L1, L2, L3, PRED, V1, V3, Y, scores, split

K = "user_id month"
NOW = "2026-01-10"
STATE = f"""WITH {V1},{V3},{split('seg')},{PRED},
cp AS (SELECT DISTINCT user_id, CAST(last_train_month + to_months(CAST(CAST(user_id AS BIGINT) % 3 AS INTEGER)) AS DATE) AS last_month FROM v1, cut WHERE CAST(user_id AS BIGINT) % 4 <> 0),
pe AS (
  SELECT pw.*, CASE WHEN {L1} IS NULL THEN 'skip' WHEN history_id = 0 THEN 'persistence' ELSE 'model' END AS route
  FROM pw LEFT JOIN cp USING (user_id), cut WHERE month > coalesce(last_month, last_train_month)),
rp AS (SELECT *, CASE route WHEN 'model' THEN three_month_average WHEN 'persistence' THEN persistence END AS prediction FROM pe),
pr AS (SELECT user_id, month, prediction, route, 'v1' AS model_version FROM rp WHERE CAST(user_id AS BIGINT) % 5 = 1 AND route <> 'skip'),
al AS (SELECT * FROM pr UNION ALL SELECT user_id, month, prediction, route, 'v2' FROM rp WHERE route <> 'skip' AND CAST(user_id AS BIGINT) % 5 <> 1),
li AS (
  SELECT al.*, {Y} AS actual, prediction - {Y} AS error FROM al JOIN v1 USING (user_id, month) WHERE month < (SELECT MAX(month) FROM v1))"""


def _floor(rows: DataFrame) -> DataFrame:
    return sided(rows, "train").agg(F.max(TIME).alias("floor_month"))


def _checkpoints(rows: DataFrame) -> DataFrame:
    number = F.col(ID).cast("long")
    users = rows.select(ID).distinct().filter(number % 4 != 0)
    return users.join(F.broadcast(_floor(rows)), F.lit(True)).select(ID, F.add_months("floor_month", (number % 3).cast("int")).alias("last_month"))


class State:
    """Rows with baselines and route, pending rows and the tables around them; a service keeps these as tables, and so does this."""

    def __init__(self, spark, d):
        rows = baselines(segmented(spark, d), more=("history_id",)).select(ID, TIME, TARGET, *LAGS, "history_id", "side", *BASELINES)
        self.rows = overwrite(rows, scratch_path(spark, "rows"))
        self.checkpoints = _checkpoints(self.rows)
        pending = serving.pending_rows(self.rows, self.checkpoints, _floor(self.rows)).withColumn("route", serving.route())
        self.pending = overwrite(serving.routed_predictions(pending, "three_month_average", "persistence"), scratch_path(spark, "pending"))
        served = self.pending.filter("route <> 'skip'")
        version = F.when(F.col(ID).cast("long") % 5 == 1, "v1").otherwise("v2")
        self.new = served.select(ID, TIME, "prediction", "route", version.alias("model_version"))
        self.existing = self.new.filter("model_version = 'v1'")

    @property
    def predictions(self) -> DataFrame:
        return serving.insert_new(self.existing, self.new)

    @property
    def live(self) -> DataFrame:
        last = self.rows.agg(F.max(TIME).alias("_last"))
        known = self.rows.join(F.broadcast(last), F.lit(True)).withColumn(TARGET, F.when(F.col(TIME) < F.col("_last"), F.col(TARGET)))
        start = self.existing.limit(0).select(ID, TIME, "model_version", "prediction", F.lit(0.0).alias("actual"), F.lit(0.0).alias("error"))
        return serving.resolve_live(self.predictions, known, start)


@query(f"{STATE}\nSELECT * FROM pe", f"{K} route", "history_id", L1)
def pending_rows(spark, d):
    return State(spark, d).pending


@query(f"{STATE}\nSELECT * FROM al", f"{K} route model_version", "", "prediction")
def insert_predictions(spark, d):
    return State(spark, d).predictions


@query(
    f"{STATE},\nu AS (SELECT user_id, last_month FROM cp UNION ALL SELECT user_id, month FROM pe)\nSELECT user_id, MAX(last_month) AS last_month FROM u GROUP BY 1",
    "user_id last_month",
)
def advance_checkpoint(spark, d):
    s = State(spark, d)
    return serving.advance_checkpoints(s.checkpoints, s.pending)


@query(
    f"{STATE}\nSELECT user_id, SUM(CASE WHEN route <> 'skip' THEN 1 ELSE 0 END) AS predicted, SUM(CASE WHEN route = 'skip' THEN 1 ELSE 0 END) AS skipped FROM pe GROUP BY 1",
    "user_id", "predicted skipped",
)
def serve_outcome(spark, d):
    return serving.serve_outcome(State(spark, d).pending)


@query(f"{STATE}\nSELECT * FROM li", f"{K} model_version", "", "prediction actual error")
def resolve_live(spark, d):
    return State(spark, d).live


@query(f"{STATE}\nSELECT * FROM li WHERE model_version = 'v2' AND route = 'model' AND month >= DATE '1998-01-01'", f"{K} route", "", "error")
def live_errors(spark, d):
    s = State(spark, d)
    return serving.live_errors(s.live, s.predictions, "v2", "model", datetime.date(1998, 1, 1))


LIVE = "AVG(abs(error)) AS mae, sqrt(AVG(error * error)) AS rmse, 100 * SUM(abs(error)) / nullif(SUM(abs(actual)), 0) AS wape, COUNT(*) AS n_rows"


@query(f"{STATE}\nSELECT model_version, {LIVE} FROM li GROUP BY 1", "model_version", "n_rows", "mae rmse wape")
def live_scores(spark, d):
    return serving.live_scores(State(spark, d).live, ("model_version",))


RECENT = "month >= (SELECT MAX(month) - INTERVAL 2 MONTH FROM li)"


@query(f"{STATE}\nSELECT * FROM li WHERE {RECENT}", f"{K} model_version", "", "error")
def recent_window(spark, d):
    return serving.recent_window(State(spark, d).live)


@query(
    f"""{STATE},
b AS (SELECT AVG(abs({Y} - three_month_average)) AS baseline_mae, DATE '2026-01-01' AS last_trained FROM pw WHERE side = 'holdout'),
s AS (SELECT {LIVE} FROM li WHERE {RECENT}),
h AS (SELECT *, CASE WHEN n_rows > 0 AND baseline_mae > 0 THEN mae / baseline_mae - 1 END AS decay FROM s, b),
r AS (SELECT *, CASE WHEN n_rows < 30 THEN 'too_few_rows' WHEN coalesce(decay <= 0.1, false) THEN 'within_tolerance' WHEN DATE '{NOW}' - last_trained < 3 THEN 'cooldown' ELSE 'decayed' END AS reason FROM h)
SELECT *, reason = 'decayed' AS retrain FROM r""",
    "reason retrain", "n_rows", "mae rmse wape baseline_mae decay",
)
def health_check(spark, d):
    s = State(spark, d)
    base = sided(s.rows, "holdout").agg(F.avg(F.abs(F.col(TARGET) - F.col("three_month_average"))).alias("baseline_mae"))
    base = base.withColumn("last_trained", F.lit("2026-01-01").cast("date"))
    return serving.health_check(s.live, base, F.lit(NOW).cast("date"))


SIDES = "mae rmse wape"


def _pair_columns(champion: str, challenger: str) -> str:
    return ", ".join(f"MAX(CASE WHEN model = '{m}' THEN {c} END) AS {side}_{c}" for side, m in (("champion", champion), ("challenger", challenger)) for c in SIDES.split())


@query(
    f"""WITH {V1},{split('v1')},{PRED},
ho AS (SELECT * FROM pl WHERE side = 'holdout'), lv AS (SELECT * FROM pl WHERE side = 'holdout' AND month >= DATE '1998-01-01'),{scores('a', 'ho', 'model', 'n_rows mae rmse wape')},{scores('b', 'lv', 'model', 'n_rows mae rmse wape')},
h AS (SELECT {_pair_columns('three_month_average', 'persistence')}, MAX(n_rows) AS champion_rows FROM a), l AS (SELECT {_pair_columns('three_month_average', 'persistence')}, MAX(n_rows) AS champion_rows FROM b),
c AS (SELECT CASE WHEN l.champion_rows >= 30 THEN 'live' ELSE 'holdout' END AS basis, {', '.join(f'CASE WHEN l.champion_rows >= 30 THEN l.{x} ELSE h.{x} END AS {x}' for x in ('champion_mae', 'champion_rmse', 'champion_wape', 'challenger_mae', 'challenger_rmse', 'challenger_wape', 'champion_rows'))} FROM h, l),
g AS (SELECT *, challenger_mae / champion_mae - 1 AS m, challenger_rmse / champion_rmse - 1 AS r, challenger_wape / champion_wape - 1 AS w FROM c)
SELECT *, CASE WHEN champion_rows < 30 THEN 'insufficient_data' WHEN -m < 0.02 THEN 'reject' WHEN r > 0.05 OR w > 0.05 THEN 'reject' ELSE 'promote' END AS outcome FROM g""",
    "basis outcome", "champion_rows", "champion_mae challenger_mae champion_rmse challenger_rmse champion_wape challenger_wape",
)
def promotion_decision(spark, d):
    """Persistence challenges the three-month average."""


    holdout = sided(predictions(supplier_panel(spark, d)), "holdout")

    def one(rows: DataFrame) -> DataFrame:
        s = scoring.score_all(rows, only=("n_rows", "mae", "rmse", "wape"))
        of = lambda side, m: [F.max(F.when(F.col("model") == m, F.col(c))).alias(f"{side}_{c}") for c in SIDES.split()]
        return s.agg(*of("champion", "three_month_average"), *of("challenger", "persistence"), F.max("n_rows").alias("champion_rows"))

    live = one(holdout.filter(F.col(TIME) >= F.lit("1998-01-01").cast("date")))
    return serving.promotion_decision(serving.promotion_basis(live, one(holdout)))


@query(f"{STATE},\ne AS (SELECT prediction - {Y} AS error, {Y} AS actual FROM rp WHERE route = 'model')\nSELECT {LIVE} FROM e", "", "n_rows", "mae rmse wape")
def scores_on_route(spark, d):
    return serving.scores_on_route(State(spark, d).pending.withColumn("truth", F.col(TARGET)))


@query(
    f"""WITH {V1},{split('v1')},{PRED},{scores('s', 'pl', 'model, side', 'n_rows mae rmse wape')}
SELECT model AS model_version, side AS split, mae, rmse, wape, n_rows, CASE WHEN model = 'persistence' THEN DATE '{NOW}' END AS promoted_at FROM s WHERE side <> 'gap'""",
    "model_version split promoted_at", "n_rows", "mae rmse wape",
)
def save_performance(spark, d):
    """The training scores are there already; saving all again adds the holdout's and stamps one version."""


    s = scoring.score_all(predictions(supplier_panel(spark, d)), ("model", "side"), ("n_rows", "mae", "rmse", "wape"))
    rows = s.select(F.col("model").alias("model_version"), F.col("side").alias("split"), "mae", "rmse", "wape", "n_rows", F.lit(None).cast("date").alias("promoted_at"))
    return serving.save_performance(rows.filter("split = 'train'"), rows, "persistence", F.lit(NOW).cast("date"))


NEXT_MONTH = f"""WITH {V1},
o AS (
  SELECT user_id, month, {Y} AS b, LAG({Y}) OVER t AS l1, LAG({Y}, 2) OVER t AS l2, COUNT(*) OVER (PARTITION BY user_id) AS n, MAX(month) OVER () AS latest,
         CASE WHEN COUNT(*) OVER w3 = 3 THEN AVG({Y}) OVER w3 END AS roll3_mean_closing_balance_usd, CASE WHEN COUNT(*) OVER w3 = 3 THEN STDDEV_SAMP({Y}) OVER w3 END AS roll3_std_closing_balance_usd,
         CASE WHEN COUNT(*) OVER w6 = 6 THEN AVG({Y}) OVER w6 END AS roll6_mean_balance, CASE WHEN COUNT(*) OVER w6 = 6 THEN STDDEV_SAMP({Y}) OVER w6 END AS roll6_std_balance,
         CASE WHEN COUNT(*) OVER w6 = 6 THEN AVG(CASE WHEN {Y} < 0 THEN 1.0 ELSE 0.0 END) OVER w6 END AS share_neg_last_6m
  FROM v1 WINDOW t AS (PARTITION BY user_id ORDER BY month), w3 AS (PARTITION BY user_id ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
       w6 AS (PARTITION BY user_id ORDER BY month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
s AS (SELECT user_id, STDDEV_SAMP(b - l1) AS s FROM o GROUP BY 1), ty AS (SELECT quantile_cont(s, 0.5) AS typical FROM s)
SELECT user_id, CAST(month + INTERVAL 1 MONTH AS DATE) AS month, b AS prev_1m_closing_balance_usd, l1 AS prev_2m_closing_balance_usd, l2 AS prev_3m_closing_balance_usd, b - l1 AS prev_1m_change,
roll3_mean_closing_balance_usd, roll3_std_closing_balance_usd, roll6_mean_balance, roll6_std_balance, share_neg_last_6m, CASE WHEN n >= 6 THEN 2 ELSE 1 END AS history_id, coalesce(CASE WHEN n >= 3 THEN s END, typical) AS step
FROM o JOIN s USING (user_id), ty WHERE month = latest"""
NEXT_NUMS = f"{L1} {L2} {L3} prev_1m_change roll3_mean_closing_balance_usd roll3_std_closing_balance_usd roll6_mean_balance roll6_std_balance share_neg_last_6m step"


@query(NEXT_MONTH, K, "history_id", NEXT_NUMS)
def next_month_panel(spark, d):
    return serving.next_month_panel(supplier_panel(spark, d))


@query(NEXT_MONTH, K, "history_id", NEXT_NUMS)
def next_month_from_carry(spark, d):
    """A carry of the months before 1997, moved on by 1997 and, twice, by what follows."""
    panel = kept(supplier_panel(spark, d).select(ID, TIME, TARGET))
    carry = spark.createDataFrame([], serving.CARRY)
    year = F.year(TIME)
    for part in (year < 1997, year == 1997, year > 1996):
        carry = serving.carry_forward(carry, panel.filter(part))
    return serving.next_month_from_carry(kept(carry))
