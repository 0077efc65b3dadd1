"""Forecasts, scores and paired comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candidates, models, moments, paired, scoring, splits
from ..sources import tables
from ..sources.panel import CREDITED, ID, LAGS, LAST, NET_FLOW, ROLL3, TARGET, TIME, V1_NUMBERS, customer_panel, supplier_panel
from .base import query
from .frames import BASELINES, baselines, labelled, fold_predictions, predictions, segmented, sided, training, windowed
from .sql import FOLDS, HOLDOUT, L1, L2, L3, P2, PRED, SCORED, SCORES, V1, V3, Y, scores, split

K = "user_id month"
SPLIT_PRED = f"WITH {V1},{split('v1')},{PRED}"


@query(f"{SPLIT_PRED}\nSELECT * FROM pw WHERE side = 'holdout'", K, "", "persistence")
def model_persistence(spark, d):
    rows = labelled(supplier_panel(spark, d))
    return models.lag_average(sided(rows, "holdout"), models.training_median(sided(rows, "train")), 1, "persistence")


@query(f"{SPLIT_PRED}\nSELECT * FROM pw WHERE side = 'holdout'", K, "", "three_month_average")
def model_three_month_average(spark, d):
    rows = labelled(supplier_panel(spark, d))
    return models.lag_average(sided(rows, "holdout"), models.training_median(sided(rows, "train")), 3, "three_month_average")


@query(f"{SPLIT_PRED}\nSELECT user_id, month, {Y} AS actual, {L1} AS last_month, persistence, three_month_average FROM pw WHERE side = 'holdout'", K, "", "actual last_month persistence three_month_average")
def sink_predictions_table(spark, d):
    rows = sided(baselines(supplier_panel(spark, d)), "holdout")
    return tables.write_predictions(rows.select(ID, TIME, F.col(TARGET).alias("actual"), F.col(LAST).alias("last_month"), *BASELINES), tables.scratch_path(spark, "predictions"))


@query(f"WITH {V1}\nSELECT user_id, month, {Y} - {L1} AS change FROM v1 WHERE {L1} IS NOT NULL", K, "", "change")
def target_change(spark, d):
    return models.target_change(supplier_panel(spark, d))


@query(f"WITH {P2}\nSELECT user_id, month, CASE WHEN {L1} IS NOT NULL THEN {L1} + {Y} / 10 ELSE {Y} / 10 END AS prediction FROM v1", K, "", "prediction")
def restore_level(spark, d):
    return customer_panel(spark, d).withColumn("prediction", models.restore_level(F.col(TARGET) / 10, F.col(LAST)))


LINEAR = ["prev_1m_closing_balance_usd", "prev_2m_closing_balance_usd", "prev_1m_net_flow_usd", ROLL3[1]]
SCALING = f"""
full_ AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {c} AS value, (SELECT quantile_cont({c}, 0.5) FROM sp WHERE side = 'train') AS median, side FROM sp" for c in LINEAR)}),
scale AS (SELECT feature, MAX(median) AS median, AVG(coalesce(value, median)) AS mean, STDDEV_POP(coalesce(value, median)) AS deviation FROM full_ WHERE side = 'train' GROUP BY 1)"""


@query(f"WITH {V1},{split('v1')},{SCALING}\nSELECT * FROM scale", "feature", "", "median mean deviation")
def impute_scale(spark, d):
    rows = labelled(supplier_panel(spark, d), LINEAR)
    return models.scaling_report(sided(rows, "train"), LINEAR).withColumnRenamed("column", "feature")


WEIGHTS = dict(zip(LINEAR, (-30.0, 12.5, 40.0, 0.0)))


@query(
    f"""WITH {V1},{split('v1')},{SCALING},
z AS (SELECT feature, CASE feature {' '.join(f"WHEN '{c}' THEN {w}" for c, w in WEIGHTS.items())} END * (coalesce(value, scale.median) - mean) / deviation AS part FROM full_ JOIN scale USING (feature) WHERE side = 'holdout'),
m AS (SELECT feature, AVG(abs(part)) AS mean_abs, AVG(part) AS mean_value FROM z GROUP BY 1)
SELECT * FROM m WHERE mean_abs > 0""",
    "feature", "", "mean_abs mean_value",
)
def shap_linear_rank(spark, d):
    rows = labelled(supplier_panel(spark, d), LINEAR)
    return models.linear_contributions(sided(rows, "holdout"), WEIGHTS, models.scaling_report(sided(rows, "train"), LINEAR))


@query(None, "feature is_zero", "", "weight")
def model_ridge(spark, d):
    train = sided(labelled(supplier_panel(spark, d), LINEAR), "train")
    return models.weights_frame(train, models.fit_linear(train, LINEAR, alpha=10.0))


@query(
    f"""WITH {V1},{split('v1')},
t AS (SELECT {L1} AS x, {Y} - {L1} AS y FROM sp WHERE side = 'train' AND {L1} IS NOT NULL),
s AS (SELECT (x - AVG(x) OVER ()) / STDDEV_POP(x) OVER () AS z, y FROM t)
SELECT '{L1}' AS feature, SUM(z * y) / (SUM(z * z) + 10.0) AS weight FROM s""",
    "feature", "", "weight:2",
)
def model_ridge_one_feature(spark, d):
    """A ridge with one feature has a closed form."""
    train = sided(labelled(supplier_panel(spark, d)), "train")
    return models.weights_frame(train, models.fit_linear(train, [LAST], alpha=10.0))


@query(None, "feature is_zero", "", "weight")
def model_elastic_net(spark, d):
    train = sided(labelled(supplier_panel(spark, d), LINEAR), "train")
    return models.weights_frame(train, models.fit_linear(train, LINEAR, alpha=50.0, l1_ratio=0.5))


@query(None, "feature is_zero", "", "weight")
def model_boosted_trees(spark, d):
    train = training(supplier_panel(spark, d), LINEAR)
    return models.weights_frame(train, models.fit_trees(train, LINEAR))


@query(f"{SPLIT_PRED}\nSELECT COUNT(*) AS n_rows, SUM(CASE WHEN persistence IS NULL THEN 1 ELSE 0 END) AS n_bad, true AS ok FROM pw WHERE side = 'holdout'", "ok", "n_rows n_bad")
def predict_guard(spark, d):
    return models.predict_guard(sided(baselines(supplier_panel(spark, d)), "holdout"), "persistence")


ROUTE = f"CASE WHEN {L1} IS NULL THEN 'skip' WHEN history_id = 0 THEN 'persistence' ELSE 'model' END"


@query(f"WITH {P2},{V3}\nSELECT user_id, month, {ROUTE} AS route FROM seg", f"{K} route")
def route_rows(spark, d):
    from ..operators import features, segments, serving

    return segments.assign_all(features.window_features(customer_panel(spark, d))).withColumn("route", serving.route())


@query(None, f"{K} route", "", "prediction")
def model_routed(spark, d):
    from ..operators import serving

    rows = labelled(segmented(spark, d), (*LINEAR, "history_id"))
    model = models.fit_linear(sided(rows, "train"), LINEAR, alpha=10.0)
    holdout = model.predict(models.with_baselines(sided(rows, "holdout"), sided(rows, "train")), "ridge")
    return serving.routed_predictions(holdout.withColumn("route", serving.route()), "ridge", "persistence")


@query(None, "feature selected", "rank n_features", "cv_wape")
def rfe_by_importance(spark, d):
    """Elimination on all five folds of the training months; the holdout has no part in it."""
    train = training(supplier_panel(spark, d), (NET_FLOW, *ROLL3[:2]))
    fit = lambda rows, features, known: models.fit_trees(rows, features, trees=3, depth=2, known=known)
    return models.eliminate(splits.expanding_folds(train), train, [*LAGS, NET_FLOW, *ROLL3[:2]], step=2, least=2, fit=fit)


@query(None, "setting state best", "seed folds", "objective")
def tune_grid_on_folds(spark, d):
    """Ridge penalties on all five folds of the training months; a negative one is rejected."""
    tagged = splits.expanding_folds(training(supplier_panel(spark, d), LINEAR))
    settings = {f"alpha={a:g}": {"alpha": a} for a in (1.0, 100.0, 10_000.0, -1.0)}
    return models.search(tagged, settings, lambda rows: models.prepared(rows, LINEAR), lambda rows, known, seed, alpha: models.fit_linear(rows, LINEAR, alpha, known=known), seeds=(1, 2))


#: Ranges of the two linear models' settings.
SPACES = {"ridge": {"alpha": candidates.Span(0.01, 1e6, log=True)}, "elastic_net": {"alpha": candidates.Span(0.01, 1e5, log=True), "l1_ratio": candidates.Span(0.05, 1.0)}}


def drawn(n: int) -> dict[str, dict]:
    return {name: s for family, space in SPACES.items() for name, s in candidates.draw(family, space, n, family=family).items()}


def _share(study: str, parameter: str) -> str:
    return f"('0x' || substr(md5('42/{study}/' || k || '/{parameter}'), 1, 13))::BIGINT / 16^13"


@query(
    f"""WITH {V1},{split('v1')},{FOLDS},
drawn AS (
    SELECT 'ridge_' || lpad(k::VARCHAR, 2, '0') AS setting, 'ridge' AS family, exp(ln(0.01) + {_share('ridge', 'alpha')} * (ln(1e6) - ln(0.01))) AS alpha, NULL AS l1_ratio FROM range(25) AS g(k)
    UNION ALL SELECT 'elastic_net_' || lpad(k::VARCHAR, 2, '0'), 'elastic_net', exp(ln(0.01) + {_share('elastic_net', 'alpha')} * (ln(1e5) - ln(0.01))),
        0.05 + {_share('elastic_net', 'l1_ratio')} * (1.0 - 0.05) FROM range(25) AS g(k)),
xm AS (SELECT fold, quantile_cont({L2}, 0.5) AS middle FROM ft WHERE fold_side = 'train' AND {Y} - {L1} IS NOT NULL GROUP BY 1),
xt AS (SELECT fold, coalesce({L2}, middle) AS x, {Y} - {L1} AS y FROM ft JOIN xm USING (fold) WHERE fold_side = 'train' AND {Y} - {L1} IS NOT NULL),
xs AS (SELECT fold, COUNT(*) AS n, AVG(x) AS ax, STDDEV_POP(x) AS sx, AVG(y) AS ay, COVAR_POP(x, y) / STDDEV_POP(x) AS slope FROM xt GROUP BY 1),
fit AS (SELECT *, CASE family WHEN 'ridge' THEN slope / (1 + alpha / n)
    ELSE sign(slope) * greatest(abs(slope) - alpha * l1_ratio, 0) / (1 + alpha * (1 - l1_ratio)) END / sx AS weight FROM drawn, xs),
err AS (SELECT setting, fold, AVG(abs({Y} - coalesce({L1}, 0) - ay - weight * (coalesce({L2}, middle) - ax))) AS mae FROM fw JOIN xm USING (fold) JOIN fit USING (fold) GROUP BY 1, 2),
ref AS (SELECT fold, AVG(abs({Y} - persistence)) AS ref FROM fw GROUP BY 1),
obj AS (SELECT setting, COUNT(*) AS folds, SUM(fold * mae / ref) / SUM(fold) AS objective FROM err JOIN ref USING (fold) GROUP BY 1)
SELECT setting, family, 'complete' AS state, row_number() OVER (PARTITION BY family ORDER BY round(objective, 9), setting) = 1 AS best, folds, alpha, l1_ratio, objective
FROM drawn JOIN obj USING (setting)""",
    "setting family state best", "folds", "alpha l1_ratio objective:6",
)
def search_one_feature(spark, d):
    """Drawn settings of both linear models on one feature, where both have closed forms."""
    rows = sided(labelled(supplier_panel(spark, d)), "train")
    return moments.search_linear(rows, splits.fold_months(rows), [LAGS[1]], drawn(25))


@query(None, "setting family state best", "folds", "alpha l1_ratio objective:6")
def search_linear_models(spark, d):
    """50 drawn settings each of ridge and elastic net on all columns of the panel, and one that is rejected."""
    rows = training(supplier_panel(spark, d), V1_NUMBERS)
    return moments.search_linear(rows, splits.fold_months(rows), list(V1_NUMBERS), drawn(50) | {"negative": {"family": "ridge", "alpha": -1.0}})


@query(None, "fold dropped", "n_features", "wape")
def rfe_by_ridge_weight(spark, d):
    """Elimination one by one from all columns of the panel, on every fold."""
    rows = training(supplier_panel(spark, d), V1_NUMBERS)
    return moments.eliminate_linear(rows, splits.fold_months(rows), list(V1_NUMBERS), alpha=10.0).withColumn("dropped", F.array_join("dropped", ","))


CV = f"WITH {V1},{split('v1')},{FOLDS},{scores('fs', 'fl', 'fold, model')}"


@query(
    f"""{CV},
r AS (SELECT a.model, a.fold, a.mae / nullif(b.mae, 0) AS ratio FROM fs a JOIN fs b ON a.fold = b.fold AND b.model = 'persistence' AND a.model <> 'persistence')
SELECT model, SUM(ratio * fold) / SUM(fold) AS objective, COUNT(*) AS folds FROM r GROUP BY 1""",
    "model", "folds", "objective",
)
def fold_ratio_objective(spark, d):
    return models.fold_objective(models.fold_ratios(fold_predictions(supplier_panel(spark, d))))


# Scores of the holdout rows.


def _holdout(spark, d):
    return sided(predictions(supplier_panel(spark, d)), "holdout")


def _score(name: str, nums: str, ints: str = ""):
    def build(spark, d):
        return scoring.score_all(_holdout(spark, d), only=tuple(x.partition(":")[0] for x in (nums + " " + ints).split()))

    build.__name__ = name
    query(f"{SCORED}\nSELECT * FROM te", "model", ints, nums)(build)


_score("score_dollar_errors", "mse:0 rmse sme mae median_ae")
_score("score_wape", "wape")
_score("score_smape", "smape")
_score("score_mape_floor", "mape mape_coverage")
_score("score_r2_level", "r2_level")
_score("score_change_framing", "r2_change mae_change rmse_change wape_change", "n_rows_change")
ALL_NUMS = "mse:0 rmse sme mae median_ae wape smape mape mape_coverage r2_level r2_change mae_change rmse_change wape_change"
SKILL = "CASE WHEN model <> 'persistence' THEN 1 - rmse / nullif((SELECT rmse FROM te WHERE model = 'persistence'), 0) END AS skill"


@query(f"{SCORED}\nSELECT model, {SKILL} FROM te", "model", "", "skill")
def score_skill(spark, d):
    return scoring.with_skill(scoring.score_all(_holdout(spark, d), only=("rmse",)))


@query(f"{SCORED}\nSELECT *, {SKILL} FROM te", "model", "n_rows n_rows_change", f"{ALL_NUMS} skill")
def score_all(spark, d):
    return scoring.with_skill(scoring.score_all(_holdout(spark, d)))


FEW = "n_rows rmse mae median_ae wape"
FEW_NUMS = "rmse mae median_ae wape"


@query(
    f"WITH {V1},{V3},{split('seg')},{PRED},{scores('g', HOLDOUT, 'model, behaviour_id', FEW)}\nSELECT * FROM g", "model", "behaviour_id n_rows", FEW_NUMS
)
def score_by_group(spark, d):
    return scoring.score_by_group(sided(predictions(segmented(spark, d), (ID, TIME, "side", "behaviour_id")), "holdout"), "behaviour_id")


@query(f"{SPLIT_PRED},{scores('g', HOLDOUT, 'model, month', FEW)}\nSELECT * FROM g", "model month", "n_rows", FEW_NUMS)
def score_by_month(spark, d):
    return scoring.score_by_group(_holdout(spark, d), TIME)


@query(f"{SPLIT_PRED},{scores('g', HOLDOUT, 'model, user_id', FEW)}\nSELECT * FROM g", "model user_id", "n_rows", FEW_NUMS)
def score_by_user(spark, d):
    return scoring.score_by_group(_holdout(spark, d), ID)


SET_NUMS = "rmse sme mae wape smape mape r2_level"


@query(
    f"""WITH {V1},{V3},{split('seg')},{PRED}
SELECT CASE WHEN GROUPING(month) = 0 THEN 'month' WHEN GROUPING(behaviour_id) = 0 THEN 'behaviour' WHEN GROUPING(user_id) = 0 THEN 'user' ELSE 'all' END AS grouping_,
model, month, behaviour_id, user_id, {', '.join(f'{SCORES[k]} AS {k}' for k in ('n_rows ' + SET_NUMS).split())}
FROM {HOLDOUT} GROUP BY GROUPING SETS ((model), (model, month), (model, behaviour_id), (model, user_id))""",
    "grouping_ model month user_id", "behaviour_id n_rows", SET_NUMS,
)
def score_sets(spark, d):
    rows = sided(predictions(segmented(spark, d), (ID, TIME, "side", "behaviour_id")), "holdout")
    sets = {"all": (), "month": (TIME,), "behaviour": ("behaviour_id",), "user": (ID,)}
    return scoring.score_sets(rows, sets, only=tuple(("n_rows " + SET_NUMS).split())).withColumnRenamed("grouping", "grouping_")


TIERS = f"""
ty AS (SELECT user_id, quantile_cont(abs({L1}), 0.5) AS typical FROM sp WHERE side = 'train' GROUP BY 1 HAVING COUNT({L1}) > 0),
tc AS (SELECT quantile_cont(typical, 0.5) AS low, quantile_cont(typical, 0.9) AS high FROM ty),
ti AS (SELECT user_id, typical, CASE WHEN typical <= low THEN 'smb' WHEN typical > high THEN 'enterprise' ELSE 'mid' END AS tier FROM ty, tc)"""


@query(f"WITH {V1},{split('v1')},{TIERS}\nSELECT * FROM ti", "user_id tier", "", "typical")
def assign_tiers(spark, d):
    return scoring.assign_tiers(sided(labelled(supplier_panel(spark, d)), "train"), LAST)


@query(
    f"""{SPLIT_PRED},{TIERS},
tp AS (SELECT pl.*, coalesce(tier, 'unassigned') AS tier FROM pl LEFT JOIN ti USING (user_id) WHERE side = 'holdout'),{scores('g', 'tp', 'model, tier', FEW)}
SELECT *, CASE tier WHEN 'smb' THEN 1 WHEN 'mid' THEN 2 WHEN 'enterprise' THEN 3 ELSE 4 END AS tier_order FROM g""",
    "model tier", "n_rows tier_order", FEW_NUMS,
)
def score_by_tier(spark, d):
    rows = baselines(supplier_panel(spark, d))
    tiers = scoring.assign_tiers(sided(rows, "train"), LAST)
    return scoring.score_by_tier(models.long_predictions(sided(rows, "holdout"), BASELINES, (ID,)), tiers)


@query(
    f"{SPLIT_PRED}\nSELECT model, {', '.join(f'quantile_cont(abs(truth - prediction), {p / 100}) AS p{p}' for p in (50, 75, 90, 95, 99))} FROM pl WHERE side = 'holdout' GROUP BY 1",
    "model", "", "p50 p75 p90 p95 p99",
)
def error_quantiles(spark, d):
    return scoring.error_quantiles(_holdout(spark, d))


WORST = f"{SPLIT_PRED},{scores('g', HOLDOUT, 'model, user_id', FEW)},\nwo AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(rmse, 6) DESC, user_id) AS rank FROM g)"


@query(f"{WORST}\nSELECT * FROM wo WHERE rank <= 10", "model user_id", "rank n_rows", FEW_NUMS)
def worst_users_topn(spark, d):
    return scoring.worst_entities(_holdout(spark, d))


@query(
    f"""{WORST},
se AS (SELECT model, user_id, SUM((truth - prediction) * (truth - prediction)) AS se FROM pl WHERE side = 'holdout' GROUP BY 1, 2)
SELECT model, SUM(CASE WHEN rank <= 10 THEN se END) / nullif(SUM(se), 0) AS top_share FROM se JOIN wo USING (model, user_id) GROUP BY 1""",
    "model", "", "top_share",
)
def top_user_error_share(spark, d):
    return scoring.top_error_share(_holdout(spark, d))


@query(
    f"""{SCORED},
b AS (SELECT 'amount' AS framing, model, r2_level AS r2, mae, rmse, wape FROM te UNION ALL SELECT 'movement', model, r2_change, mae_change, rmse_change, wape_change FROM te)
SELECT *, row_number() OVER (PARTITION BY framing ORDER BY wape NULLS LAST, model) AS rank FROM b""",
    "framing model", "rank", "r2 mae rmse wape",
)
def leaderboard(spark, d):
    return scoring.leaderboard(scoring.score_all(_holdout(spark, d)))


BOARD = "rmse mae median_ae wape smape p90_ae sme r2_level r2_change mae_change rmse_change wape_change skill"


@query(
    f"""{SCORED},
p AS (SELECT model, quantile_cont(abs(truth - prediction), 0.9) AS p90_ae FROM {HOLDOUT} GROUP BY 1),
b AS (SELECT *, {SKILL} FROM te JOIN p USING (model))
SELECT *, row_number() OVER (ORDER BY wape NULLS LAST, model) AS rank FROM b""",
    "model", "rank", BOARD,
)
def comparison_table(spark, d):
    return scoring.comparison_table(_holdout(spark, d), sort_by="wape")


@query(f"{SCORED}\nSELECT * FROM tr", "model", "n_rows n_rows_change", ALL_NUMS)
def in_sample_scores(spark, d):
    return scoring.score_all(sided(predictions(supplier_panel(spark, d)), "train"))


BOTH = ("mse", "rmse", "mae", "median_ae", "sme", "smape")
TVT = f"""SELECT te.model, {', '.join(f'tr.{c} AS train_{c}, te.{c} AS test_{c}' for c in BOTH)}, te.mae / nullif(tr.mae, 0) AS gap, te.wape AS test_wape, te.wape_change AS test_wape_change,
te.r2_change AS test_r2_change, CASE WHEN te.model <> 'persistence' THEN 1 - te.rmse / nullif(r.rmse, 0) END AS skill, 1 - te.mae / nullif(r.mae, 0) AS skill_mae
FROM te LEFT JOIN tr USING (model), (SELECT * FROM te WHERE model = 'persistence') r"""
TVT_NUMS = " ".join([f"{s}_{c}" + ":0" * (c == "mse") for c in BOTH for s in ("train", "test")] + ["gap", "test_wape", "test_wape_change", "test_r2_change", "skill", "skill_mae"])


def _sides(panel):
    """Scores of both sides in one pass, collected: a row per side and model, or each use made them again."""
    scored = scoring.score_all(predictions(panel), ("side", "model"))
    s = panel.sparkSession.createDataFrame(scored.collect(), scored.schema)
    return sided(s, "train").drop("side"), sided(s, "holdout").drop("side")


@query(f"{SCORED}\n{TVT}", "model", "", TVT_NUMS)
def train_vs_test(spark, d):
    return scoring.train_vs_test(*_sides(supplier_panel(spark, d)))


@query(
    f"""{SCORED}
SELECT te.model, tr.wape AS train_wape, te.wape AS test_wape, te.wape * te.rmse / nullif(te.mae, 0) AS test_nrmse, te.smape AS test_smape, te.rmse / nullif(te.mae, 0) AS rmse_by_mae,
te.wape_change AS test_wape_change, te.mae / nullif(r.mae, 0) AS mase, te.r2_change AS r2_change, 100 * (te.mae / nullif(tr.mae, 0) - 1) AS gap_percent,
CASE WHEN te.wape IS NULL THEN 'n/a' WHEN te.wape < 10 THEN 'highly accurate' WHEN te.wape < 20 THEN 'good' WHEN te.wape < 50 THEN 'reasonable' ELSE 'poor' END AS grade
FROM te LEFT JOIN tr USING (model), (SELECT * FROM te WHERE model = 'persistence') r""",
    "model grade", "", "train_wape test_wape test_nrmse test_smape rmse_by_mae test_wape_change mase r2_change gap_percent",
)
def train_vs_test_percent(spark, d):
    return scoring.train_vs_test_percent(*_sides(supplier_panel(spark, d)))


CMP_NUMS = "test_mae test_wape gap skill_mae"
_one = lambda p: f"WITH {p},{split('v1')},{PRED},{scores('te', HOLDOUT)},{scores('tr', '''(SELECT * FROM pl WHERE side = 'train')''')}"


def _compare_sql() -> str:
    of = lambda tag, p: f"(SELECT '{tag}' AS table_name, * FROM ({_one(p)} {TVT}))"
    return f"WITH a AS {of('suppliers', V1)}, b AS {of('customers', P2)}\nSELECT * FROM a UNION ALL SELECT * FROM b"


@query(_compare_sql(), "table_name model", "", CMP_NUMS)
def compare_tables(spark, d):
    each = {"suppliers": supplier_panel, "customers": customer_panel}
    return scoring.compare_tables({n: scoring.train_vs_test(*_sides(p(spark, d))) for n, p in each.items()})


@query(f"{CV}\nSELECT * FROM fs", "model", "fold n_rows n_rows_change", ALL_NUMS)
def cv_fold_scores(spark, d):
    return scoring.score_all(fold_predictions(supplier_panel(spark, d)), ("fold", "model"))


@query(
    f"{CV}\nSELECT model, AVG(mae) AS mae, AVG(rmse) AS rmse, AVG(wape) AS wape, AVG(wape_change) AS wape_change, STDDEV_SAMP(wape) AS wape_std, COUNT(*) AS folds FROM fs GROUP BY 1",
    "model", "folds", "mae rmse wape wape_change wape_std",
)
def cv_summary(spark, d):
    return scoring.cv_summary(scoring.score_all(fold_predictions(supplier_panel(spark, d)), ("fold", "model")))


SEGS = ("sign_regime_id", "size_id", "behaviour_id")
SEG_FOLDS = f"""WITH {V1},{V3},{split('seg')},{FOLDS},
un AS ({' UNION ALL '.join(f"SELECT *, '{c}' AS segmentation, {c} AS segment FROM fl" for c in SEGS)}),{scores('sf', 'un', 'fold, model, segmentation, segment', 'n_rows wape')}"""


@query(f"{SEG_FOLDS}\nSELECT * FROM sf", "model segmentation", "fold segment n_rows", "wape")
def segment_fold_wape(spark, d):
    return scoring.segment_fold_wape(fold_predictions(segmented(spark, d), SEGS), SEGS)


@query(
    f"""{SEG_FOLDS},
j AS (SELECT a.*, b.wape AS ref FROM sf a LEFT JOIN sf b ON b.model = 'persistence' AND (a.segmentation, a.segment, a.fold) = (b.segmentation, b.segment, b.fold) WHERE a.model <> 'persistence'),
s AS (SELECT segmentation, segment, model, AVG(n_rows) AS rows_per_fold, AVG(ref) AS reference_wape, AVG(wape) AS wape, SUM(CASE WHEN wape < ref THEN 1 ELSE 0 END) AS folds_won, COUNT(*) AS folds FROM j GROUP BY 1, 2, 3)
SELECT *, reference_wape - wape AS gain, coalesce(reference_wape - wape > 0 AND folds_won >= 4 AND rows_per_fold >= 100, false) AS passes,
CASE WHEN segment = 0 THEN 'unassigned' WHEN segmentation = 'sign_regime_id' THEN ['not_always_negative', 'shallow_negative', 'deep_negative'][segment] WHEN segmentation = 'size_id' THEN ['small', 'medium', 'large'][segment] ELSE ['stable', 'variable', 'erratic'][segment] END AS category FROM s""",
    "segmentation model category passes", "segment folds_won folds", "rows_per_fold reference_wape wape gain",
)
def segment_cv_summary(spark, d):
    from ..operators import segments

    labels = None
    for s in segments.standard()[:3]:
        own = s.lookup(spark).select(F.lit(f"{s.name}_id").alias("segmentation"), F.col("id").alias("segment"), "category")
        labels = own if labels is None else labels.unionByName(own)
    return scoring.segment_cv_summary(scoring.segment_fold_wape(fold_predictions(segmented(spark, d), SEGS), SEGS), labels)


# Paired comparisons on holdout rows: two challengers against persistence, then against each other.

PAIRS = (("persistence", "three_month_average"), ("persistence", "two_month_average"), ("three_month_average", "two_month_average"))
SCENARIOS = {"all_rows": f"{Y} IS NOT NULL", "dynamic_overdraft": "sign_flips_6m >= 2", "zero_income": f"{CREDITED} = 0", "gig_income": "income_cv_6m >= 1.0"}
TWO = f"coalesce((coalesce({L1}, 0) + coalesce({L2}, 0)) / nullif(CAST({L1} IS NOT NULL AS INT) + CAST({L2} IS NOT NULL AS INT), 0), median_target)"
PAIRED = f"""WITH {V1},{V3},{split('v3')},{PRED},
sl AS ({' UNION ALL '.join(f"SELECT *, {TWO} AS two_month_average, '{n}' AS scenario FROM pw WHERE side = 'holdout' AND {c}" for n, c in SCENARIOS.items())}),
pp AS ({' UNION ALL '.join(f"SELECT scenario, user_id, '{a}' AS champion, '{b}' AS challenger, abs({Y} - {a}) AS ea, abs({Y} - {b}) AS eb FROM sl" for a, b in PAIRS)}),
pu AS (SELECT scenario, champion, challenger, user_id, SUM(eb - ea) AS diff_sum, COUNT(*) AS n, AVG(eb - ea) AS diff_mean, SUM(ea) AS champion_sum, SUM(eb) AS challenger_sum FROM pp GROUP BY ALL)"""
ONE = "scenario = 'all_rows' AND champion = 'persistence' AND challenger = 'three_month_average'"


SCENARIO_COLUMNS = (CREDITED, "sign_flips_6m", "income_cv_6m")


def _compared(spark, d, more: tuple[str, ...] = SCENARIO_COLUMNS):
    panel = windowed(spark, d) if more else supplier_panel(spark, d)
    return sided(baselines(panel, {"two_month_average": 2}, more), "holdout").withColumn("truth", F.col(TARGET))


def _users(spark, d):
    return paired.per_user(paired.of_pairs(_compared(spark, d, ()), PAIRS[:1]))


@query(f"{PAIRED}\nSELECT * FROM sl", f"{K} scenario")
def scenario_slices(spark, d):
    return paired.slice_rows(_compared(spark, d))


@query(
    f"""{SPLIT_PRED},
a AS (SELECT * FROM pw WHERE side = 'holdout' AND mi % 6 <> 0), b AS (SELECT * FROM pw WHERE side = 'holdout' AND mi % 4 <> 0),
j AS (SELECT a.user_id AS ua, b.user_id AS ub, a.{Y} AS ta, b.{Y} AS tb FROM a FULL OUTER JOIN b ON a.user_id = b.user_id AND a.month = b.month)
SELECT COUNT(*) FILTER (WHERE ua IS NOT NULL AND ub IS NOT NULL) AS in_both, COUNT(*) FILTER (WHERE ub IS NULL) AS only_first, COUNT(*) FILTER (WHERE ua IS NULL) AS only_second, COUNT(*) FILTER (WHERE ua IS NOT NULL AND ub IS NOT NULL AND ta IS DISTINCT FROM tb) AS truth_differs FROM j""",
    "", "in_both only_first only_second truth_differs",
)
def prediction_alignment(spark, d):
    rows = sided(baselines(supplier_panel(spark, d)), "holdout").withColumn("truth", F.col(TARGET))
    return paired.alignment(rows.filter("month_index % 6 <> 0"), rows.filter("month_index % 4 <> 0"))


@query(f"{PAIRED}\nSELECT * FROM pu WHERE {ONE}", "user_id", "n", "diff_sum diff_mean")
def paired_user_diff(spark, d):
    return _users(spark, d)


CI = f"""
nu AS (SELECT scenario, user_id, row_number() OVER (PARTITION BY scenario ORDER BY substr(md5(user_id), 1, 3), user_id) - 1 AS no, COUNT(*) OVER (PARTITION BY scenario) AS users
       FROM (SELECT DISTINCT scenario, user_id FROM pu)),
slots AS (SELECT scenario, users, no AS place, draw FROM nu, range(0, {paired.DRAWS}) AS g(draw)),
picked AS (SELECT scenario, draw, CAST('0x' || substr(md5(concat_ws('|', CAST(draw AS VARCHAR), CAST(place AS VARCHAR), '{paired.SEED}')), 1, 8) AS BIGINT) % users AS no FROM slots),
bs AS (SELECT scenario, champion, challenger, draw, SUM(diff_sum) / SUM(n) AS x FROM picked JOIN nu USING (scenario, no) JOIN pu USING (scenario, user_id) GROUP BY ALL),
ci AS (SELECT scenario, champion, challenger, quantile_cont(x, 0.025) AS ci_low, quantile_cont(x, 0.975) AS ci_high FROM bs GROUP BY ALL)"""


@query(f"{PAIRED},{CI}\nSELECT * FROM ci WHERE {ONE}", "", "", "ci_low ci_high")
def paired_bootstrap_ci(spark, d):
    return paired.bootstrap_ci(_users(spark, d))


G = "scenario, champion, challenger"
WX = f"""
wd AS (SELECT {G}, round(diff_mean, 6) AS d FROM pu WHERE round(diff_mean, 6) <> 0),
wr AS (SELECT {G}, d, rank() OVER (PARTITION BY {G} ORDER BY abs(d)) + (COUNT(*) OVER (PARTITION BY {G}, abs(d)) - 1) / 2.0 AS r, COUNT(*) OVER (PARTITION BY {G}, abs(d)) AS t FROM wd),
wx AS (SELECT {G}, SUM(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, SUM(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus, CAST(COUNT(*) AS DOUBLE) AS n, SUM(CAST(t AS DOUBLE) * t - 1) AS ties FROM wr GROUP BY ALL),
wy AS (SELECT *, (least(w_plus, w_minus) - n * (n + 1) / 4) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 0) AS z FROM wx),
wt AS (SELECT *, 1 / (1 + {paired.ERFC_AT} * abs(z) / sqrt(2.0)) AS u FROM wy),
wn AS (SELECT *, ({' + '.join(f'{c} * pow(u, {k})' for k, c in enumerate(paired.ERFC, 1))}) * exp(-z * z / 2) AS p_normal FROM wt),
c0 AS MATERIALIZED (SELECT 0 AS s, CAST(1 AS DOUBLE) AS k),
{', '.join(f"c{r} AS MATERIALIZED (SELECT s, SUM(k) AS k FROM (SELECT s, k FROM c{r - 1} UNION ALL SELECT s + {r}, k FROM c{r - 1}) GROUP BY s)" for r in range(1, paired.EXACT_USERS + 1))},
sub AS ({' UNION ALL '.join(f"SELECT {r} AS size, s, k FROM c{r}" for r in range(1, paired.EXACT_USERS + 1))}),
we AS (SELECT {G}, least(1.0, 2 * SUM(k) / pow(2.0, n)) AS p_exact FROM wn JOIN sub ON size = n AND s <= least(w_plus, w_minus) WHERE ties = 0 GROUP BY {G}, n),
wz AS (SELECT {G}, w_plus, w_minus, n, z, p_normal, p_exact, coalesce(p_exact, p_normal) AS p_value FROM wn LEFT JOIN we USING ({G}))"""


@query(f"{PAIRED},{WX}\nSELECT * FROM wz WHERE {ONE}", "", "n", "w_plus w_minus z p_normal p_exact p_value")
def wilcoxon_signed_rank(spark, d):
    return paired.wilcoxon(_users(spark, d))


REPORT = f"""
to_ AS (SELECT {G}, SUM(n) AS n_rows, COUNT(*) AS n_users, SUM(champion_sum) / SUM(n) AS champion_mae, SUM(challenger_sum) / SUM(n) AS challenger_mae FROM pu GROUP BY ALL)
SELECT *, 100 * (challenger_mae - champion_mae) / nullif(champion_mae, 0) AS mae_change_pct,
CASE WHEN round(ci_high, 6) < 0 THEN 'challenger better' WHEN round(ci_low, 6) > 0 THEN 'champion better' ELSE 'no difference' END AS verdict FROM to_ JOIN ci USING ({G}) LEFT JOIN wz USING ({G})"""
REPORT_NUMS = "champion_mae challenger_mae mae_change_pct ci_low ci_high z p_value"


@query(f"{PAIRED},{CI},{WX},{REPORT} WHERE {ONE}", "champion challenger verdict", "", "mae_change_pct ci_low ci_high p_value")
def paired_verdict(spark, d):
    return paired.report(_compared(spark, d, ()), PAIRS[:1], ())


@query(f"{PAIRED},{CI},{WX},{REPORT}", "scenario champion challenger verdict", "n_rows n_users", REPORT_NUMS)
def scenario_report(spark, d):
    return paired.report(paired.slice_rows(_compared(spark, d)), PAIRS)


@query(f"WITH {P2},{split('v1')},{PRED}\nSELECT user_id, month, coalesce({L2}, {L3}, median_target) AS fallback FROM pw WHERE side = 'holdout'", K, "", "fallback")
def no_balance_fallback(spark, d):
    rows = labelled(customer_panel(spark, d))
    return paired.fallback(sided(rows, "holdout"), models.training_median(sided(rows, "train")))


@query(
    f"""{SPLIT_PRED},
n AS (SELECT {Y} AS truth, coalesce({L2}, {L3}, median_target) AS fallback, median_target AS persistence,
  coalesce((coalesce({L2}, 0) + coalesce({L3}, 0)) / nullif(CAST({L2} IS NOT NULL AS INT) + CAST({L3} IS NOT NULL AS INT), 0), median_target) AS three_month_average FROM pw WHERE side = 'holdout'),
m AS (SELECT AVG(abs(truth - fallback)) AS f, AVG(abs(truth - persistence)) AS p, AVG(abs(truth - three_month_average)) AS t FROM n),
r AS (SELECT 'persistence' AS model, p AS mae, f AS fallback_mae FROM m UNION ALL SELECT 'three_month_average', t, f FROM m)
SELECT *, mae / fallback_mae AS ratio, mae <= 1.5 * fallback_mae AS passes FROM r""",
    "model passes", "", "mae fallback_mae ratio",
)
def no_balance_check(spark, d):
    rows = labelled(supplier_panel(spark, d))
    train = sided(rows, "train")
    blank = sided(rows, "holdout").withColumn(LAST, F.lit(None).cast("double"))
    both = paired.fallback(models.with_baselines(blank, train), models.training_median(train))
    s = scoring.score_all(models.long_predictions(both, (*BASELINES, "fallback")), only=("mae",))
    ref = s.filter("model = 'fallback'").select(F.col("mae").alias("fallback_mae"))
    out = s.filter("model <> 'fallback'").join(F.broadcast(ref), F.lit(True))
    return out.withColumns({"ratio": F.try_divide("mae", "fallback_mae"), "passes": F.col("mae") <= 1.5 * F.col("fallback_mae")})


assert LAGS == (L1, L2, L3)
