"""Sources, validation, expressions, features, segments and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import features, segments, splits, validation
from ..sources import tables
from ..sources.panel import COUNTS, ID, LAGS, LAST, ROLL3, SPEND, TARGET, TIME, V1_NUMBERS, Panel, customer_panel, supplier_panel, table
from .base import query
from .frames import segmented, windowed
from .sql import L1, L2, L3, P2, V1, V3, safe, split

K = "user_id month"
V1_ALL = " ".join((TARGET, *V1_NUMBERS))
MEAN = f"((coalesce({L1}, 0) + coalesce({L2}, 0) + coalesce({L3}, 0)) / nullif(CAST({L1} IS NOT NULL AS INT) + CAST({L2} IS NOT NULL AS INT) + CAST({L3} IS NOT NULL AS INT), 0))"


@query(f"WITH {V1}\nSELECT *, mi AS month_index FROM v1", K, "month_index", V1_ALL)
def src_panel_typed(spark, d):
    return tables.typed_panel(supplier_panel(spark, d))


LABELS = """CASE sign_regime_id WHEN 0 THEN 'unassigned' WHEN 1 THEN 'not_always_negative' WHEN 2 THEN 'shallow_negative' ELSE 'deep_negative' END AS sign_regime_category,
 CASE size_id WHEN 0 THEN 'unassigned' WHEN 1 THEN 'small' WHEN 2 THEN 'medium' ELSE 'large' END AS size_category,
 CASE behaviour_id WHEN 0 THEN 'unassigned' WHEN 1 THEN 'stable' WHEN 2 THEN 'variable' ELSE 'erratic' END AS behaviour_category,
 CASE history_id WHEN 0 THEN 'unassigned' WHEN 1 THEN 'thin' ELSE 'full' END AS history_category"""


@query(f"WITH {V1},{V3}\nSELECT user_id, month, {LABELS} FROM seg", f"{K} sign_regime_category size_category behaviour_category history_category")
def src_segment_labels(spark, d):
    return tables.with_segment_labels(segmented(spark, d), {s.name: s.lookup(spark) for s in segments.standard()})


@query(f"WITH {V1}\nSELECT * FROM v1 WHERE mi % 5 = 0 AND CAST(user_id AS BIGINT) % 3 = 1", K, "", V1_ALL)
def src_keyed_fetch(spark, d):
    panel = supplier_panel(spark, d)
    return tables.fetch_keys(panel, panel.filter((F.col("month_index") % 5 == 0) & (F.col(ID).cast("long") % 3 == 1)).select(ID, TIME))


@query(f"WITH {V1}\nSELECT * FROM v1", K, "", V1_ALL)
def sink_overwrite_table(spark, d):
    path = tables.scratch_path(spark, "overwrite")
    panel = supplier_panel(spark, d)
    tables.overwrite(panel.limit(1), path)  # the second write replaces the first
    return tables.overwrite(panel, path)


V2_NUMS = " ".join((TARGET, *LAGS, *COUNTS, *features.V2_DERIVED))


def _v2_sql() -> str:
    total = "(" + " + ".join(f"coalesce({c}, 0)" for c in SPEND) + ")"
    cols = {
        "month_sin": "sin(2 * pi() * month(month) / 12)", "month_cos": "cos(2 * pi() * month(month) / 12)",
        "ratio_balance_to_roll3": safe(L1, f"abs({MEAN})"), "mom_growth_1_2": safe(f"{L1} - {L2}", f"abs({L2})"), "mom_growth_2_3": safe(f"{L2} - {L3}", f"abs({L3})"),
        "growth_3": f"({safe(f'{L1} - {L3}', f'abs({L3})')}) / 2", "cv_balance_roll3": safe(ROLL3[1], f"abs({MEAN})"),
        "ratio_credited_to_debited": safe("prev_1m_total_credited_usd", "prev_1m_total_debited_usd"), "net_flow_to_balance": safe("prev_1m_net_flow_usd", f"abs({L1})"),
        "ratio_net_flow_to_roll3": safe("prev_1m_net_flow_usd", f"abs({ROLL3[2]})"),
        **{"share" + c.removeprefix("prev_1m").removesuffix("_usd"): safe(c, total, clip=None) for c in SPEND},
        "spend_to_balance": safe(total, f"abs({L1})"), "avg_debit_per_txn": safe("prev_1m_total_debited_usd", COUNTS[0], 1, None),
    }
    return f"WITH {V1}\nSELECT user_id, month, {', '.join((TARGET, *LAGS, *COUNTS))}, {', '.join(f'{v} AS {k}' for k, v in cols.items())} FROM v1"


V2 = _v2_sql()


@query(V2, K, "", V2_NUMS)
def sink_v2_table(spark, d):
    return tables.overwrite(features.ratio_table(supplier_panel(spark, d)), tables.scratch_path(spark, "v2"))


@query(f"WITH {V1}\nSELECT * FROM v1", K, "", V1_ALL)
def sink_append_rows(spark, d):
    panel = supplier_panel(spark, d)
    last = F.col(TIME) >= F.lit("1998-01-01").cast("date")
    path = tables.scratch_path(spark, "append")
    tables.append(panel.filter(~last), path)
    return tables.append(panel.filter(last), path)


@query(f"WITH {V1}\nSELECT * FROM v1", K, "", V1_ALL)
def coerce_types(spark, d):
    panel = supplier_panel(spark, d)
    raw = panel.drop("month_index").select(*[F.col(c).cast("string").alias(c) for c in panel.columns if c != "month_index"]).withColumnRenamed(TIME, "date")
    return validation.coerce_types(raw, {"date": TIME}, strict=False)


@query(
    f"WITH {V1}\nSELECT COUNT(*) AS n_rows, SUM(CASE WHEN month IS NULL THEN 1 ELSE 0 END) AS n_null_months, (SELECT COUNT(*) FROM (SELECT 1 FROM v1 GROUP BY user_id, month HAVING COUNT(*) > 1)) AS n_duplicate_keys, 0 AS n_missing_columns, true AS is_valid FROM v1",
    "is_valid", "n_rows n_null_months n_duplicate_keys n_missing_columns",
)
def validate_panel(spark, d):
    return validation.validation_report(supplier_panel(spark, d))


@query(f"WITH {V1}\nSELECT user_id, month, {TARGET} FROM v1 WHERE month < (SELECT MAX(month) FROM v1)", K, "", TARGET)
def drop_missing_target(spark, d):
    panel = supplier_panel(spark, d)
    last = panel.agg(F.max(TIME).alias("_last"))
    hidden = panel.join(F.broadcast(last), F.lit(True)).withColumn(TARGET, F.when(F.col(TIME) < F.col("_last"), F.col(TARGET)))
    return validation.drop_missing_target(hidden)


SELECTED = " ".join((*LAGS, "prev_1m_net_flow_usd", *ROLL3))


@query(f"WITH {V1}\nSELECT * FROM v1", K, "", f"{TARGET} {SELECTED}")
def select_features(spark, d):
    panel = supplier_panel(spark, d)
    drop = {"month_index", *SPEND, *COUNTS, "prev_1m_total_credited_usd", "prev_1m_total_debited_usd"}
    chosen = validation.select_features(panel, drop=drop)
    return chosen.df.select(chosen.id, chosen.time, chosen.target, *chosen.features)


@query(f"WITH {V1}\nSELECT user_id, month, {TARGET} FROM v1 WHERE month(month) IN (3, 6)", K, "", TARGET)
def take_months(spark, d):
    panel = supplier_panel(spark, d)
    return validation.take_months(panel, panel.filter(F.month(TIME).isin(3, 6)).select(F.date_add(TIME, 9).alias(TIME)))


@query(
    f"WITH {V1}\nSELECT COUNT(*) AS n_rows, COUNT(DISTINCT user_id) AS n_entities, COUNT(DISTINCT month) AS n_months, MIN(month) AS first_month, MAX(month) AS last_month, {len(V1_NUMBERS)} AS n_features FROM v1",
    "first_month last_month", "n_rows n_entities n_months n_features",
)
def panel_summary(spark, d):
    return validation.panel_summary(Panel(supplier_panel(spark, d), features=V1_NUMBERS))


@query(f"WITH {V1}\nSELECT DISTINCT month FROM v1", "month")
def distinct_months(spark, d):
    return validation.distinct_months(supplier_panel(spark, d))


def unpivot_sql(source: str, columns, value: str = "value", keep: str = "") -> str:
    """One row per column of ``source``."""
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS {value}{keep} FROM {source}" for c in columns)


@query(f"WITH {V1},\nu AS ({unpivot_sql('v1', V1_NUMBERS)})\nSELECT \"column\" AS column_name, AVG(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS null_share FROM u GROUP BY 1", "column_name", "", "null_share")
def null_share_by_column(spark, d):
    return validation.null_shares(supplier_panel(spark, d), V1_NUMBERS).withColumnRenamed("column", "column_name")


@query(
    f"""WITH {V1},{split('v1')},
s AS (SELECT user_id, quantile_cont(abs({L1}), 0.5) AS size FROM sp WHERE side = 'train' GROUP BY 1 HAVING COUNT({L1}) > 0),
w AS (SELECT user_id, row_number() OVER (ORDER BY size DESC, user_id) AS r, COUNT(*) OVER () AS n FROM s)
SELECT user_id, month, {TARGET} FROM v1 WHERE user_id NOT IN (SELECT user_id FROM w WHERE r <= floor(n * 0.1 + 1e-9))""",
    K, "", TARGET,
)
def trim_whale_entities(spark, d):
    return validation.trim_whales(supplier_panel(spark, d), LAST, 0.1)


@query(
    f"""WITH {V1},
h AS (SELECT md5(concat_ws('|', strftime(month, '%Y-%m-%d'), CAST(mi AS VARCHAR), CAST(CAST({TARGET} AS BIGINT) AS VARCHAR), user_id)) AS h FROM v1),
s AS (SELECT COUNT(*) AS n, SUM(CAST('0x' || substr(h, 1, 8) AS BIGINT)) AS a, SUM(CAST('0x' || substr(h, 9, 8) AS BIGINT)) AS b, SUM(CAST('0x' || substr(h, 17, 8) AS BIGINT)) AS c, SUM(CAST('0x' || substr(h, 25, 8) AS BIGINT)) AS d FROM h)
SELECT n AS n_rows, md5(concat_ws('|', 'month,month_index,target,user_id', CAST(n AS VARCHAR), CAST(a AS VARCHAR), CAST(b AS VARCHAR), CAST(c AS VARCHAR), CAST(d AS VARCHAR))) AS digest FROM s""",
    "digest", "n_rows",
)
def panel_fingerprint(spark, d):
    return validation.fingerprint(supplier_panel(spark, d).select(ID, TIME, "month_index", F.col(TARGET).cast("long").alias("target")))


@query(
    f"WITH {V1}\nSELECT user_id, month, {safe('prev_1m_net_flow_usd', 'prev_1m_total_debited_usd')} AS clipped, {safe('prev_1m_total_debited_usd', COUNTS[0], 1, None)} AS counted FROM v1",
    K, "", "clipped counted",
)
def safe_divide(spark, d):
    flow, debit, n = map(F.col, ("prev_1m_net_flow_usd", "prev_1m_total_debited_usd", COUNTS[0]))
    return supplier_panel(spark, d).withColumns({"clipped": exprs.guarded_ratio(flow, debit), "counted": exprs.guarded_ratio(debit, n, exprs.COUNT_EPSILON, None)})


@query(f"WITH {P2}\nSELECT user_id, month, {MEAN} AS lag_mean FROM v1", K, "", "lag_mean")
def row_mean_skip_null(spark, d):
    return customer_panel(spark, d).withColumn("lag_mean", exprs.row_mean(LAGS))


@query(f"WITH {P2}\nSELECT user_id, month, {' + '.join(f'coalesce({c}, 0)' for c in SPEND)} AS spend FROM v1", K, "", "spend")
def row_sum_null_zero(spark, d):
    return customer_panel(spark, d).withColumn("spend", exprs.row_sum(SPEND))


def _some(name: str, columns: str, build):
    """A query of some columns of the ratio table."""
    build.__name__ = name
    query(V2, K, "", columns)(build)


_some("month_cyclic", "month_sin month_cos", lambda s, d: supplier_panel(s, d).withColumns(exprs.month_cyclic(F.col(TIME))))
_some("v2_balance_ratios", "ratio_balance_to_roll3 mom_growth_1_2 mom_growth_2_3 growth_3 cv_balance_roll3", lambda s, d: features.balance_ratios(supplier_panel(s, d)))
_some("v2_flow_ratios", "ratio_credited_to_debited net_flow_to_balance ratio_net_flow_to_roll3", lambda s, d: features.flow_ratios(supplier_panel(s, d)))
_some("v2_spend_shares", " ".join(c for c in features.V2_DERIVED if "spend" in c), lambda s, d: features.spend_shares(supplier_panel(s, d)))
_some("v2_behaviour_ratio", "avg_debit_per_txn", lambda s, d: features.behaviour_ratio(supplier_panel(s, d)))
_some("v2_table", V2_NUMS, lambda s, d: features.ratio_table(supplier_panel(s, d)))

W3, W3_SPARSE = f"WITH {V1},{V3}\nSELECT * FROM v3", f"WITH {P2},{V3}\nSELECT * FROM v3"


def _window(name: str, columns: str, *builders, ints: str = "", sparse: bool = False):
    def build(spark, d) -> DataFrame:
        df = (customer_panel if sparse else supplier_panel)(spark, d)
        for b in builders:
            df = b(df)
        return df

    build.__name__ = name
    query(W3_SPARSE if sparse else W3, K, ints, columns)(build)


_window("win_balance_trend", "roll6_mean_balance roll6_std_balance roll6_slope_balance eom_cv_6m", features.balance_trend, ints="history_months")
_window("win_change", "prev_1m_change roll3_mean_change", features.change)
_window("win_flow_volatility", "roll6_std_net_flow net_flow_cv change_volatility_6m", features.balance_trend, features.flow_volatility)
_window("win_income", "turnover_roll6 flow_volatility_6m income_cv_6m repayment_ratio", features.balance_trend, features.flow_volatility, features.income)
_rest = (features.balance_trend, features.flow_volatility, features.income, features.sign_history, features.debt_depth)
_window("win_share_negative", "share_neg_last_6m", features.sign_history)
_window("win_months_since_flip", "months_since_sign_flip", features.sign_history)
_window("win_sign_flips", "sign_flips_6m", features.sign_history)
_window("win_debt_depth", "debt_depth_6m", *_rest)
_window("win_max_drawdown", "drawdown_6m", features.drawdown)
_window("win_sparse_panel", "prev_1m_change months_since_sign_flip roll6_mean_balance", *features.BUILDERS, ints="history_months", sparse=True)
_window("v3_features_all", " ".join(features.V3_DERIVED), *features.BUILDERS, ints="history_months")


@query(f"WITH {V1},{V3}\nSELECT * FROM seg", K, " ".join(features.SEGMENT_IDS), " ".join((TARGET, *V1_NUMBERS, *features.V3_DERIVED)))
def sink_bucketed_table(spark, d):
    """All features of the panel's bucketed table, whose windows need no exchange.  A month has a line at least, so lines, which are counted already, bound its rows."""
    path = tables.scratch_path(spark, "bucketed")
    buckets = tables.buckets_for(table(spark, d, "lineitem").count())
    panel = tables.bucketed(supplier_panel(spark, d), f"panel_{path[-12:]}", path, buckets)
    return features.feature_table(segments.assign_all(features.window_features(panel)))


@query(f"WITH {V1},{V3}\nSELECT * FROM seg", K, " ".join(features.SEGMENT_IDS), " ".join((TARGET, *V1_NUMBERS, *features.V3_DERIVED)))
def v3_feature_table(spark, d):
    return features.feature_table(segmented(spark, d))


@query(
    f"WITH {V1},{V3}\nSELECT user_id, month, CASE WHEN history_months < 1 THEN 0 WHEN net_flow_cv <= 0.5 THEN 1 WHEN net_flow_cv <= 1.5 THEN 2 WHEN net_flow_cv > 1.5 THEN 3 ELSE 0 END AS flow_id FROM v3",
    K, "flow_id",
)
def seg_threshold_bands(spark, d):
    return segments.by_cuts("flow", "net_flow_cv", [0.5, 1.5], [("even", ""), ("uneven", ""), ("wild", "")]).assign(windowed(spark, d))


def _segment(name: str, ids: str):
    def build(spark, d) -> DataFrame:
        df = windowed(spark, d)
        for s in segments.standard():
            if f"{s.name}_id" in ids.split():
                df = s.assign(df)
        return df

    build.__name__ = name
    query(f"WITH {V1},{V3}\nSELECT * FROM seg", K, ids)(build)


_segment("seg_sign_regime", "sign_regime_id")
_segment("seg_size", "size_id")
_segment("seg_behaviour", "behaviour_id")
_segment("seg_history", "history_id")
_segment("seg_assign", "sign_regime_id size_id behaviour_id history_id")


@query(
    f"""WITH {V1},{V3},{split('seg')},
n AS (SELECT size_id AS segment, COUNT(*) FILTER (WHERE side = 'train') AS train, COUNT(*) FILTER (WHERE side = 'holdout') AS holdout FROM sp GROUP BY 1)
SELECT *, train / SUM(train) OVER () AS train_share, holdout / SUM(holdout) OVER () AS holdout_share, segment <> 0 AND least(train, holdout) < 100 AS small FROM n""",
    "small", "segment train holdout", "train_share holdout_share",
)
def seg_counts_by_region(spark, d):
    return segments.counts_by_region(splits.holdout_labels(segmented(spark, d)), "size_id", "side")


@query(f"WITH {V1},{split('v1', 2)}\nSELECT * FROM cut", "last_train_month first_test_month", "n_months train_end test_start")
def split_cut_positions(spark, d):
    return splits.cut_report(supplier_panel(spark, d), gap=2)


@query(f"WITH {V1},{split('v1', 2)}\nSELECT user_id, month, side FROM sp", f"{K} side")
def split_holdout(spark, d):
    return splits.holdout_labels(supplier_panel(spark, d), gap=2)


ALL_FOLDS = f"""WITH {V1},{split('v1')},
fb AS (SELECT row_number() OVER (ORDER BY ts) AS fold, ts, ts + 3 AS te FROM (SELECT DISTINCT n - s * 3 - 3 AS ts FROM mr, range(5) AS g(s)) WHERE ts >= 6),
ff AS (SELECT v1.user_id, month, fold, CASE WHEN r <= ts THEN 'train' ELSE 'validate' END AS fold_side FROM v1 JOIN mr USING (month), fb WHERE r <= te)"""


@query(f"{ALL_FOLDS}\nSELECT * FROM ff", f"{K} fold_side", "fold")
def split_expanding_folds(spark, d):
    return splits.expanding_folds(supplier_panel(spark, d))


@query(
    f"{ALL_FOLDS},\nl AS (SELECT fold, MAX(CASE WHEN fold_side = 'train' THEN month END) AS last_train, MIN(CASE WHEN fold_side = 'validate' THEN month END) AS first_validate FROM ff GROUP BY 1)\nSELECT *, last_train < first_validate AS no_leak FROM l",
    "last_train first_validate no_leak", "fold",
)
def split_leak_check(spark, d):
    return splits.leak_check(splits.expanding_folds(supplier_panel(spark, d)))


@query(f"WITH {V1}\nSELECT user_id, month, month > DATE '1997-06-01' AS after FROM v1", f"{K} after")
def split_on_boundary(spark, d):
    import datetime

    before, after = splits.split_on_boundary(supplier_panel(spark, d), datetime.date(1997, 6, 1))
    return before.withColumn("after", F.lit(False)).unionByName(after.withColumn("after", F.lit(True)))


@query(
    f"WITH {V1},{split('v1')}\nSELECT MIN(month) FILTER (WHERE side = 'holdout') AS first_scored, MAX(month) FILTER (WHERE side = 'train') AS trained_through, true AS models_agree, MIN(month) FILTER (WHERE side = 'holdout') > MAX(month) FILTER (WHERE side = 'train') AS out_of_sample FROM sp",
    "first_scored trained_through models_agree out_of_sample",
)
def check_out_of_sample(spark, d):
    rows = splits.holdout_labels(supplier_panel(spark, d))
    trained = rows.filter("side = 'train'").agg(F.max(TIME).alias("trained_through"))
    both = trained.withColumn("model", F.explode(F.array(F.lit("persistence"), F.lit("three_month_average"))))
    return splits.out_of_sample(rows.filter("side = 'holdout'"), both)
