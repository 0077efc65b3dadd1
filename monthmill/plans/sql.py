"""SQL of the shared steps, for DuckDB: each is a list of named subqueries to put behind WITH."""

from __future__ import annotations

from ..sources.panel import COUNTS, CREDITED, DEBITED, LAGS, LAST, NET_FLOW, SPEND
from ..sources.panel import TARGET as Y

L1, L2, L3 = LAGS


def safe(top: str, bottom: str, epsilon: float = 100, clip: float | None = 25) -> str:
    ratio = f"(({top}) / ({bottom}))"
    if clip is not None:
        ratio = f"least(greatest({ratio}, -{clip}.0), {clip}.0)"
    return f"CASE WHEN ({top}) IS NOT NULL AND abs({bottom}) >= {epsilon} THEN {ratio} END"


def _panel(monthly: str) -> str:
    at = lambda k: f"MAX(b) OVER (PARTITION BY u ORDER BY mi RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING)"
    one = {NET_FLOW: "nf", CREDITED: "cr", DEBITED: "db", **{c: f"s{k}" for k, c in enumerate(SPEND)}, **dict(zip(COUNTS, ("n", "nm", "acc")))}
    return f"""{monthly},
bal AS (SELECT *, year(m) * 12 + month(m) AS mi, cr - db AS nf, SUM(cr - db) OVER (PARTITION BY u ORDER BY m) AS b FROM mon),
v1 AS (
  SELECT CAST(u AS VARCHAR) AS user_id, m AS month, mi, b AS {Y}, {', '.join(f'{at(k)} AS {c}' for k, c in enumerate(LAGS, 1))},
         {', '.join(f'MAX({x}) OVER w1 AS {c}' for c, x in one.items())},
         AVG(b) OVER w3 AS roll3_mean_closing_balance_usd, STDDEV_SAMP(b) OVER w3 AS roll3_std_closing_balance_usd,
         AVG(nf) OVER w3 AS roll3_mean_net_flow_usd, AVG(cr) OVER w3 AS roll3_mean_total_credited_usd, AVG(db) OVER w3 AS roll3_mean_total_debited_usd
  FROM bal
  WINDOW w1 AS (PARTITION BY u ORDER BY mi RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING),
         w3 AS (PARTITION BY u ORDER BY mi RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING))"""


_sums = lambda debit, kind: ", ".join(f"SUM(CASE WHEN {kind} % 7 = {k} THEN {debit} ELSE 0.0 END) AS s{k}" for k in range(7))

V1 = _panel(f"""mon AS (
  SELECT l_suppkey AS u, CAST(date_trunc('month', l_shipdate) AS DATE) AS m,
         SUM(CASE WHEN l_returnflag <> 'R' THEN amt ELSE 0.0 END) AS cr, SUM(CASE WHEN l_returnflag = 'R' THEN 2 * amt ELSE 0.0 END) AS db,
         {_sums("CASE WHEN l_returnflag = 'R' THEN 2 * amt ELSE 0.0 END", "l_partkey")},
         CAST(COUNT(*) AS DOUBLE) AS n, CAST(COUNT(DISTINCT l_partkey) AS DOUBLE) AS nm, CAST(COUNT(DISTINCT l_linestatus) AS DOUBLE) AS acc
  FROM (SELECT *, CAST(FLOOR(l_extendedprice * (1 - l_discount) / 40 * CASE l_suppkey % 3 WHEN 0 THEN 0.25 WHEN 1 THEN 1.0 ELSE 3.0 END) AS DOUBLE) AS amt FROM lineitem)
  GROUP BY 1, 2)""")

P2 = _panel(f"""mon AS (
  SELECT o_custkey AS u, CAST(date_trunc('month', o_orderdate) AS DATE) AS m,
         SUM(CASE WHEN o_orderstatus <> 'F' THEN amt ELSE 0.0 END) AS cr, SUM(CASE WHEN o_orderstatus = 'F' THEN amt ELSE 0.0 END) AS db,
         {_sums("CASE WHEN o_orderstatus = 'F' THEN amt ELSE 0.0 END", "o_orderkey")},
         CAST(COUNT(*) AS DOUBLE) AS n, CAST(COUNT(DISTINCT o_orderpriority) AS DOUBLE) AS nm, CAST(COUNT(DISTINCT o_orderstatus) AS DOUBLE) AS acc
  FROM (SELECT *, CAST(FLOOR(o_totalprice / 100) AS DOUBLE) AS amt FROM orders)
  GROUP BY 1, 2)""")

_full = lambda agg, basis, n=6: f"CASE WHEN COUNT({basis}) OVER w{n} = {n} THEN {agg} OVER w{n} END"
_frame = lambda n: f"w{n} AS (PARTITION BY user_id ORDER BY mi RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

V3 = f"""
x AS (SELECT *, {L1} AS b, {L1} - {L2} AS prev_1m_change, CAST(({L1} < 0) <> ({L2} < 0) AS INTEGER) AS flip,
             {NET_FLOW} AS f, {CREDITED} AS c, abs({DEBITED}) AS d FROM v1),
y AS (
  SELECT *, COUNT(b) OVER w6 AS history_months, {_full("AVG(b)", "b")} AS roll6_mean_balance, {_full("STDDEV_SAMP(b)", "b")} AS roll6_std_balance,
         CASE WHEN COUNT(b) OVER w6 = 6 THEN COVAR_POP(mi, b) OVER w6 / nullif(VAR_POP(CASE WHEN b IS NOT NULL THEN mi END) OVER w6, 0) END AS roll6_slope_balance,
         {_full("AVG(prev_1m_change)", "prev_1m_change", 3)} AS roll3_mean_change,
         {_full("STDDEV_SAMP(f)", "f")} AS roll6_std_net_flow, AVG(f) OVER w6 AS mean_flow,
         {_full("AVG(c + d)", "c + d")} AS turnover_roll6, {_full("AVG(c)", "c")} AS mean_c, STDDEV_SAMP(c) OVER w6 AS std_c, AVG(d) OVER w6 AS mean_d,
         {_full("AVG(CASE WHEN b < 0 THEN 1.0 WHEN b >= 0 THEN 0.0 END)", "b")} AS share_neg_last_6m,
         CAST(coalesce(mi - MAX(CASE WHEN flip = 1 THEN mi END) OVER h + 1, COUNT(b) OVER h) AS DOUBLE) AS months_since_sign_flip,
         {_full("SUM(flip)", "flip", 5)} AS sign_flips_6m, {_full("MIN(b)", "b")} AS trough
  FROM x
  WINDOW {_frame(3)}, {_frame(5)}, {_frame(6)}, h AS (PARTITION BY user_id ORDER BY mi RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pk AS (
  SELECT r.user_id, r.mi, p.b, MAX(p.b) OVER (PARTITION BY r.user_id, r.mi ORDER BY p.mi) AS peak
  FROM x r JOIN x p ON p.user_id = r.user_id AND p.mi BETWEEN r.mi - 5 AND r.mi AND p.b IS NOT NULL),
dd AS (
  SELECT user_id, mi, CASE WHEN COUNT(*) = 6 THEN least(greatest(MAX(CASE WHEN abs(peak) >= 100 THEN (peak - b) / abs(peak) ELSE 0.0 END), 0.0), 2.0) END AS drawdown_6m
  FROM pk GROUP BY 1, 2),
v3 AS (
  SELECT *, {safe("roll6_std_balance", "roll6_mean_balance").replace("/ (roll6_mean_balance)", "/ abs(roll6_mean_balance)")} AS eom_cv_6m,
         {safe("roll6_std_net_flow", "abs(mean_flow)")} AS net_flow_cv, {safe("roll6_std_net_flow", "abs(roll6_mean_balance)")} AS change_volatility_6m,
         {safe("roll6_std_net_flow", "turnover_roll6")} AS flow_volatility_6m, {safe("std_c", "abs(mean_c)")} AS income_cv_6m,
         {safe("mean_c", "mean_d")} AS repayment_ratio, {safe("CASE WHEN trough IS NOT NULL THEN greatest(-trough, 0.0) END", "turnover_roll6")} AS debt_depth_6m
  FROM y LEFT JOIN dd USING (user_id, mi)),
seg AS (
  SELECT *, CASE WHEN history_months < 1 THEN 0 WHEN share_neg_last_6m <= 0.9 THEN 1 WHEN share_neg_last_6m > 0.9 AND debt_depth_6m <= 2 THEN 2
                 WHEN share_neg_last_6m > 0.9 THEN 3 ELSE 0 END AS sign_regime_id,
         CASE WHEN history_months < 1 THEN 0 WHEN turnover_roll6 <= 5000 THEN 1 WHEN turnover_roll6 <= 20000 THEN 2 WHEN turnover_roll6 > 20000 THEN 3 ELSE 0 END AS size_id,
         CASE WHEN history_months < 3 THEN 0 WHEN flow_volatility_6m <= 0.2 THEN 1 WHEN flow_volatility_6m <= 0.5 THEN 2 WHEN flow_volatility_6m > 0.5 THEN 3 ELSE 0 END AS behaviour_id,
         CASE WHEN history_months < 1 THEN 0 WHEN history_months <= 5 THEN 1 ELSE 2 END AS history_id
  FROM v3)"""


def split(base: str, gap: int = 0) -> str:
    """sp: ``base`` with ``side``; mr: ranks of months; cut: the bounds."""
    return f"""
mr AS (SELECT month, row_number() OVER (ORDER BY month) AS r, COUNT(*) OVER () AS n FROM (SELECT DISTINCT month FROM {base})),
cut AS (
  SELECT MAX(n) AS n_months, MAX(n) - floor(round(MAX(n) * 0.2, 9)) - {gap} AS train_end, MAX(n) - floor(round(MAX(n) * 0.2, 9)) AS test_start,
         MAX(CASE WHEN r <= n - floor(round(n * 0.2, 9)) - {gap} THEN month END) AS last_train_month,
         MIN(CASE WHEN r > n - floor(round(n * 0.2, 9)) THEN month END) AS first_test_month
  FROM mr),
sp AS (SELECT {base}.*, CASE WHEN month <= last_train_month THEN 'train' WHEN month >= first_test_month THEN 'holdout' ELSE 'gap' END AS side FROM {base}, cut)"""


MEAN3 = f"(coalesce({L1}, 0) + coalesce({L2}, 0) + coalesce({L3}, 0)) / nullif(CAST({L1} IS NOT NULL AS INT) + CAST({L2} IS NOT NULL AS INT) + CAST({L3} IS NOT NULL AS INT), 0)"

#: pw: rows with both baselines; pl: the same, a row per model.
PRED = f"""
med AS (SELECT quantile_cont({Y}, 0.5) AS median_target FROM sp WHERE side = 'train'),
pw AS (SELECT sp.*, median_target, coalesce({L1}, median_target) AS persistence, coalesce({MEAN3}, median_target) AS three_month_average FROM sp, med),
pl AS (SELECT *, 'persistence' AS model, {Y} AS truth, {L1} AS anchor, persistence AS prediction FROM pw
       UNION ALL SELECT *, 'three_month_average', {Y}, {L1}, three_month_average FROM pw)"""

E = "(truth - prediction)"
ME = "CASE WHEN anchor IS NOT NULL THEN truth - prediction END"
MOVE = "(truth - anchor)"
SCORES = {
    "n_rows": "COUNT(*)",
    "mse": f"AVG({E} * {E})",
    "rmse": f"sqrt(AVG({E} * {E}))",
    "sme": f"AVG({E})",
    "mae": f"AVG(abs({E}))",
    "median_ae": f"quantile_cont(abs({E}), 0.5)",
    "wape": f"100 * SUM(abs({E})) / nullif(SUM(abs(truth)), 0)",
    "smape": f"100 * AVG(CASE WHEN abs(truth) + abs(prediction) > 0 THEN 2 * abs({E}) / (abs(truth) + abs(prediction)) END)",
    "mape": f"100 * AVG(CASE WHEN abs(truth) >= 1000 THEN abs({E}) / abs(truth) END)",
    "mape_coverage": "AVG(CASE WHEN abs(truth) >= 1000 THEN 1.0 ELSE 0.0 END)",
    "r2_level": f"1 - SUM({E} * {E}) / nullif(VAR_POP(truth) * COUNT(truth), 0)",
    "r2_change": f"1 - SUM(({ME}) * ({ME})) / nullif(VAR_POP({MOVE}) * COUNT({MOVE}), 0)",
    "n_rows_change": f"COUNT({MOVE})",
    "mae_change": f"AVG(abs({ME}))",
    "rmse_change": f"sqrt(AVG(({ME}) * ({ME})))",
    "wape_change": f"100 * SUM(abs({ME})) / nullif(SUM(abs({MOVE})), 0)",
}


def scores(name: str, source: str, by: str = "model", only: str = "") -> str:
    wanted = only.split() or list(SCORES)
    return f"\n{name} AS (SELECT {by}, {', '.join(f'{SCORES[k]} AS {k}' for k in wanted)} FROM {source} GROUP BY {by})"


HOLDOUT = "(SELECT * FROM pl WHERE side = 'holdout')"
TRAIN = "(SELECT * FROM pl WHERE side = 'train')"
#: Everything up to scores of the holdout (te) and of the training rows (tr).
SCORED = f"WITH {V1},{split('v1')},{PRED},{scores('te', HOLDOUT)},{scores('tr', TRAIN)}"

#: fl: folds of the training months with both baselines, a row per model; medians are each fold's own.
FOLDS = f"""
fr AS (SELECT month, row_number() OVER (ORDER BY month) AS r, COUNT(*) OVER () AS n FROM (SELECT DISTINCT month FROM sp WHERE side = 'train')),
fb AS (SELECT row_number() OVER (ORDER BY ts) AS fold, ts, ts + 3 AS te FROM (SELECT DISTINCT n - s * 3 - 3 AS ts FROM fr, range(5) AS g(s)) WHERE ts >= 6),
fm AS (SELECT month, fold, CASE WHEN r <= ts THEN 'train' ELSE 'validate' END AS fold_side FROM fr, fb WHERE r <= te),
ft AS (SELECT sp.*, fold, fold_side FROM sp JOIN fm USING (month) WHERE side = 'train'),
fmed AS (SELECT fold, quantile_cont({Y}, 0.5) AS median_target FROM ft WHERE fold_side = 'train' GROUP BY 1),
fw AS (SELECT ft.*, coalesce({L1}, median_target) AS persistence, coalesce({MEAN3}, median_target) AS three_month_average FROM ft JOIN fmed USING (fold) WHERE fold_side = 'validate'),
fl AS (SELECT *, 'persistence' AS model, {Y} AS truth, {L1} AS anchor, persistence AS prediction FROM fw
       UNION ALL SELECT *, 'three_month_average', {Y}, {L1}, three_month_average FROM fw)"""
assert LAST == L1
