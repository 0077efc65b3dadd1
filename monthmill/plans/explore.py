"""Exploration and data-quality jobs."""

from __future__ import annotations

from itertools import combinations


from ..operators import quality, splits
from ..sources.panel import LAGS, V1_NUMBERS, customer_panel, supplier_panel
from .base import query
from .frames import sided
from .prepare import unpivot_sql
from .sql import P2, V1, Y, split

Q = lambda p, c=Y: f"quantile_cont({c}, {p})"


@query(
    f"WITH {V1}\nSELECT MIN({Y}) AS min, {', '.join(f'{Q(p / 100)} AS p{p}' for p in (1, 5, 25, 50, 75, 95, 99))}, MAX({Y}) AS max, AVG({Y}) AS mean, {Q(0.95)} - {Q(0.05)} AS middle_90 FROM v1",
    "", "", "min p1 p5 p25 p50 p75 p95 p99 max mean middle_90",
)
def eda_quantiles(spark, d):
    return quality.target_quantiles(supplier_panel(spark, d))


@query(
    f"""WITH {V1},
m AS (SELECT month, AVG({Y}) AS mean, {Q(0.5)} AS median, {Q(0.1)} AS p10, {Q(0.25)} AS p25, {Q(0.75)} AS p75, {Q(0.9)} AS p90, COUNT(*) AS n_rows FROM v1 GROUP BY 1),
g AS (SELECT *, mean - LAG(mean) OVER (ORDER BY month) AS move FROM m)
SELECT *, coalesce(abs(move) = MAX(abs(move)) OVER (), false) AS largest_move FROM g""",
    "month largest_move", "n_rows", "mean median p10 p25 p75 p90 move",
)
def eda_target_over_time(spark, d):
    return quality.target_over_time(supplier_panel(spark, d))


COLUMNS = [*LAGS, "prev_1m_net_flow_usd", "roll3_mean_closing_balance_usd", "accounts_held"]


@query(
    f"""WITH {P2},
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY month) <= 3 AS early FROM v1),
u AS ({unpivot_sql('r', COLUMNS, keep=', early')})
SELECT "column" AS column_name, SUM(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS n_missing, 100 * AVG(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS percent_missing,
SUM(CASE WHEN value IS NULL AND early THEN 1 ELSE 0 END) / nullif(SUM(CASE WHEN value IS NULL THEN 1 ELSE 0 END), 0) AS early_share FROM u GROUP BY 1""",
    "column_name", "n_missing", "percent_missing early_share",
)
def eda_missing(spark, d):
    return quality.missing(customer_panel(spark, d), COLUMNS).withColumnRenamed("column", "column_name")


@query(
    f"""WITH {V1},
s AS (SELECT MIN({Y}) AS lo, MAX({Y}) AS hi, coalesce((MAX({Y}) - MIN({Y})) / nullif({Q(0.75)} - {Q(0.25)}, 0) > 30, true) AS heavy, greatest({Q(0.5, f'abs({Y})')} / 10, 1) AS lin FROM v1),
x AS (SELECT *, CASE WHEN heavy THEN sign({Y}) * ln(1 + abs({Y}) / lin) ELSE {Y} END AS v, CASE WHEN heavy THEN sign(lo) * ln(1 + abs(lo) / lin) ELSE lo END AS a, CASE WHEN heavy THEN sign(hi) * ln(1 + abs(hi) / lin) ELSE hi END AS b FROM v1, s)
SELECT least(coalesce(floor((v - a) * 40 / nullif(b - a, 0) + 1e-9), 0), 39) AS bin, heavy, COUNT(*) AS n_rows FROM x GROUP BY 1, 2""",
    "heavy", "bin n_rows",
)
def eda_symlog_histogram(spark, d):
    return quality.symlog_histogram(supplier_panel(spark, d))


@query(
    f"""WITH {V1}, u AS ({unpivot_sql('v1', V1_NUMBERS)}), n AS (SELECT "column" AS c, round(value, 6) AS value, COUNT(*) AS n FROM u GROUP BY 1, 2),
t AS (SELECT c AS column_name, MAX(n) / SUM(n) AS top_share, COUNT(value) AS n_values FROM n GROUP BY 1)
SELECT *, top_share >= 0.99 OR n_values <= 10 AS flagged FROM t""",
    "column_name flagged", "n_values", "top_share",
)
def eda_near_constant(spark, d):
    return quality.near_constant(supplier_panel(spark, d), list(V1_NUMBERS)).withColumnRenamed("column", "column_name")


@query(f"WITH {V1},{split('v1')}\nSELECT user_id, month, {Y} FROM sp WHERE side = 'train'", "user_id month", "", Y)
def eda_train_slice(spark, d):
    return sided(splits.holdout_labels(supplier_panel(spark, d)), "train")


SOME = [Y, *LAGS, "roll3_mean_closing_balance_usd", "prev_1m_txn_count"]
PAIRS = ", ".join(f"CORR({a}, {b}) AS r{k}" for k, (a, b) in enumerate(combinations(SOME, 2)))
PEARSON = f"""WITH {V1}, one AS (SELECT {PAIRS} FROM v1),
pe AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, r{k} AS r FROM one" for k, (a, b) in enumerate(combinations(SOME, 2)))})"""


@query(f"{PEARSON}\nSELECT * FROM pe", "a b", "", "r")
def corr_pearson(spark, d):
    return quality.pearson(supplier_panel(spark, d), SOME)


@query(
    f"""WITH {V1},
l AS ({' UNION ALL '.join(f"SELECT '{c}' AS column_name, {c} AS x, {Y} AS y FROM v1 WHERE {c} IS NOT NULL" for c in SOME[1:])}),
k AS (SELECT *, rank() OVER (PARTITION BY column_name ORDER BY x) + (COUNT(*) OVER (PARTITION BY column_name, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY column_name ORDER BY y) + (COUNT(*) OVER (PARTITION BY column_name, y) - 1) / 2.0 AS ry FROM l)
SELECT column_name, CORR(rx, ry) AS rho, CORR(x, y) AS r, abs(CORR(rx, ry) - CORR(x, y)) AS gap FROM k GROUP BY 1""",
    "column_name", "", "rho r gap",
)
def corr_spearman(spark, d):
    return quality.spearman(supplier_panel(spark, d), Y, SOME[1:]).withColumnRenamed("column", "column_name")


@query(
    f"""{PEARSON}, st AS (SELECT * FROM pe WHERE abs(r) >= 0.9), en AS (SELECT c, COUNT(*) AS n FROM (SELECT a AS c FROM st UNION ALL SELECT b FROM st) GROUP BY 1)
SELECT a, b, r, x.n AS pairs_of_a, y.n AS pairs_of_b FROM st JOIN en x ON a = x.c JOIN en y ON b = y.c""",
    "a b", "pairs_of_a pairs_of_b", "r",
)
def corr_strong_pairs(spark, d):
    return quality.strong_pairs(quality.pearson(supplier_panel(spark, d), SOME))


USERS = f"u AS (SELECT user_id, COUNT({Y}) AS n_rows, AVG({Y}) AS mean, {Q(0.5)} AS median, STDDEV_SAMP({Y}) AS std FROM v1 GROUP BY 1)"


@query(
    f"WITH {V1}, {USERS}\nSELECT *, (SELECT STDDEV_SAMP(mean) / nullif(AVG(std), 0) FROM u) AS between_within FROM u ORDER BY mean DESC, user_id LIMIT 15",
    "user_id", "n_rows", "mean median std between_within",
)
def eda_user_differences(spark, d):
    return quality.top_users(quality.user_differences(supplier_panel(spark, d)))


@query(
    f"""WITH {V1}, u AS (SELECT * FROM ({unpivot_sql('v1', V1_NUMBERS)}) WHERE value IS NOT NULL),
q AS (SELECT "column" AS c, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM u GROUP BY 1),
b AS (SELECT c, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q)
SELECT c AS column_name, low, high, SUM(CASE WHEN value < low OR value > high THEN 1 ELSE 0 END) AS n_outside, 100 * AVG(CASE WHEN value < low OR value > high THEN 1.0 ELSE 0.0 END) AS percent_outside FROM u JOIN b ON "column" = c GROUP BY 1, 2, 3""",
    "column_name", "n_outside", "low high percent_outside",
)
def eda_outliers_iqr(spark, d):
    return quality.outliers_iqr(supplier_panel(spark, d), list(V1_NUMBERS)).withColumnRenamed("column", "column_name")


@query(
    f"WITH {P2}, u AS (SELECT user_id, COUNT(DISTINCT month) AS n_months FROM v1 GROUP BY 1)\nSELECT n_months, COUNT(*) AS n_users, n_months < 4 AS short FROM u GROUP BY 1, 3",
    "short", "n_months n_users",
)
def eda_history_coverage(spark, d):
    return quality.history_coverage(customer_panel(spark, d))


@query(f"WITH {P2}\nSELECT month, COUNT(DISTINCT user_id) AS n_users FROM v1 GROUP BY 1", "month", "n_users")
def eda_users_by_month(spark, d):
    return quality.users_by_month(customer_panel(spark, d))


@query(
    f"WITH {V1}, t AS (SELECT CAST(month - INTERVAL 1 MONTH AS DATE) AS month, SUM(prev_1m_txn_count) AS n_transactions FROM v1 GROUP BY 1)\nSELECT * FROM t WHERE n_transactions IS NOT NULL",
    "month", "n_transactions",
)
def eda_txn_by_month(spark, d):
    return quality.transactions_by_month(supplier_panel(spark, d))


@query(
    f"WITH {P2}, t AS (SELECT user_id, COUNT(*) AS n FROM v1 GROUP BY 1 ORDER BY n DESC, user_id LIMIT 1)\nSELECT user_id, month, {Y} FROM v1 JOIN t USING (user_id)",
    "user_id month", "", Y,
)
def eda_user_series(spark, d):
    return quality.longest_series(customer_panel(spark, d))


_nulls = lambda source, columns: " UNION ALL ".join(f"SELECT '{c}' AS c, SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n FROM {source}" for c in columns)
ONLY_A, ONLY_B = ("user_id", "month", Y, *LAGS, "accounts_held"), ("user_id", "month", Y, *LAGS, "prev_1m_net_flow_usd")


@query(
    f"""WITH {V1}, a AS ({_nulls('v1', ONLY_A)}), b AS ({_nulls('v1', ONLY_B)})
SELECT coalesce(a.c, b.c) AS column_name, a.n AS nulls_a, b.n AS nulls_b, CASE WHEN b.n IS NULL THEN 'a' WHEN a.n IS NULL THEN 'b' ELSE 'both' END AS present_in FROM a FULL OUTER JOIN b ON a.c = b.c""",
    "column_name present_in", "nulls_a nulls_b",
)
def table_profile(spark, d):
    panel = supplier_panel(spark, d)
    return quality.table_profile(panel.select(*ONLY_A), panel.select(*ONLY_B)).withColumnRenamed("column", "column_name")


