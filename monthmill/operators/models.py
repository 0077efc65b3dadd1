"""Forecasts: naive baselines, linear models and boosted trees on the month's change, routing.

Statistics (medians, deviations) come from training rows, one aggregate each, and are
broadcast as a single row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import finite, row_mean
from ..sources.panel import LAGS, LAST, TARGET
from ..sources.tables import kept
from .ordered import exact_quantiles, median_row
from .scoring import score_all


def training_median(train: DataFrame, target: str = TARGET) -> DataFrame:
    return median_row(train, F.col(target), "median_target")


def lag_average(rows: DataFrame, middle: DataFrame, months: int, name: str) -> DataFrame:
    """Mean of whichever of the last ``months`` balances exist, else the training median (``middle``, one row)."""
    return rows.join(F.broadcast(middle), F.lit(True)).withColumn(name, F.coalesce(row_mean(LAGS[:months]), "median_target")).drop("median_target")


def with_baselines(rows: DataFrame, train: DataFrame, more: dict[str, int] | None = None) -> DataFrame:
    """``rows`` with persistence, the three-month average and further averages by name.

    The training median is collected, one number, so that readings of the rows don't look for it again.
    """
    middle = F.lit(training_median(train).first().median_target).cast("double")
    averages = {"persistence": 1, "three_month_average": 3} | (more or {})
    return rows.withColumns({name: F.coalesce(row_mean(LAGS[:months]), middle) for name, months in averages.items()})


def long_predictions(rows: DataFrame, models: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., model, truth, prediction, anchor) rows."""
    base = rows.select(*keep, F.col(TARGET).alias("truth"), F.col(LAST).alias("anchor"), *models)
    return base.unpivot([*keep, "truth", "anchor"], list(models), "model", "prediction")


def target_change(rows: DataFrame) -> DataFrame:
    """The label: target less last month's balance; rows without it don't train."""
    return rows.withColumn("change", F.col(TARGET) - F.col(LAST)).filter(finite(F.col("change")))


def restore_level(change: Column, anchor: Column) -> Column:
    """anchor + change; the bare change without an anchor."""
    return F.when(anchor.isNotNull(), anchor + change).otherwise(change)


@dataclass(frozen=True)
class Scaling:
    medians: dict[str, float]
    means: dict[str, float]
    deviations: dict[str, float]

    def of(self, columns: list[str]) -> Scaling:
        return Scaling(*[{c: d[c] for c in columns} for d in (self.medians, self.means, self.deviations)])

    def apply(self, df: DataFrame, prefix: str = "z_") -> DataFrame:
        """Imputed and standardised copies of the columns."""
        z = lambda c: (F.coalesce(F.nanvl(F.col(c), F.lit(None)), F.lit(self.medians[c])) - self.means[c]) / (self.deviations[c] or 1.0)
        return df.withColumns({prefix + c: z(c) for c in self.medians})


def _medians(train: DataFrame, columns: list[str]) -> DataFrame:
    """(column, median), exact; columns without a value are absent."""
    long = train.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value").withColumn("value", F.nullif("value", F.lit(float("nan"))))
    return exact_quantiles(long, "value", (0.5,), ("column",)).select("column", F.col("q").alias("median"))


def fit_scaling(train: DataFrame, columns: list[str], *more: Column) -> tuple[Scaling, dict]:
    """Medians of the training rows, then mean and population deviation of the imputed columns; further aggregates in the same pass."""
    m = {c: 0.0 for c in columns} | {r.column: r.median for r in _medians(train, columns).collect()}
    full = {c: F.coalesce(F.nullif(F.col(c).cast("double"), F.lit(float("nan"))), F.lit(m[c])) for c in columns}
    s = train.agg(*[F.avg(x).alias(f"m_{c}") for c, x in full.items()], *[F.stddev_pop(x).alias(f"s_{c}") for c, x in full.items()], *more).first().asDict()
    return Scaling(m, {c: s[f"m_{c}"] or 0.0 for c in columns}, {c: s[f"s_{c}"] or 0.0 for c in columns}), s


def scaling_report(train: DataFrame, columns: list[str]) -> DataFrame:
    """(column, median, mean, deviation) without leaving Spark."""
    long = train.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    full = long.join(F.broadcast(_medians(train, columns)), "column", "left").withColumn("full", F.coalesce("value", "median"))
    return full.groupBy("column").agg(F.max("median").alias("median"), F.avg("full").alias("mean"), F.stddev_pop("full").alias("deviation"))


@dataclass
class ChangeModel:
    """A fitted model of the change; ``weights`` are coefficients or importances by feature."""

    features: list[str]
    pipeline: PipelineModel
    scaling: Scaling
    weights: dict[str, float] = field(default_factory=dict)

    def predict(self, rows: DataFrame, name: str) -> DataFrame:
        out = self.pipeline.transform(_inputs(self.scaling.apply(rows), self.features))
        made = [c for c in out.columns if c not in rows.columns]
        return out.withColumn("_p", restore_level(F.col("prediction"), F.col(LAST))).drop(*made).withColumnRenamed("_p", name)

    def zero_weights(self) -> list[str]:
        return [f for f, w in self.weights.items() if w == 0]

    def weakest(self, n: int = 10) -> list[str]:
        return sorted(self.weights, key=lambda f: (abs(self.weights[f]), f))[:n]


def _inputs(df: DataFrame, features: list[str]) -> DataFrame:
    """Missing values are imputed; a flag keeps that they were."""
    return df.withColumns({f"miss_{c}": F.col(c).isNull().cast("double") for c in features})


def prepared(train: DataFrame, features: list[str]) -> tuple[Scaling, dict]:
    """What fits of the same rows share: the features' scaling, and the label's deviation and number."""
    return fit_scaling(target_change(train), features, F.stddev_pop("change").alias("d"), F.count(F.lit(1)).alias("n"))


def fit_linear(train: DataFrame, features: list[str], alpha: float, l1_ratio: float = 0.0, known: tuple[Scaling, dict] | None = None) -> ChangeModel:
    """Squared loss with penalties as on summed squares (ridge) or mean squares (elastic net) of standardised features.

    The library scales its penalty by the label's deviation and the number of rows, hence the mapping.
    ``known``: what ``prepared`` gives, if it is at hand.
    """
    if alpha < 0 or not 0 <= l1_ratio <= 1:
        raise ValueError(f"alpha must not be negative and l1_ratio lie in [0, 1], not {alpha} and {l1_ratio}")
    rows = target_change(train)
    scaling, s = known or prepared(train, features)
    scaling = scaling.of(features)
    if l1_ratio and alpha:
        l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio) * s["d"]
        reg, net, solver = l1 + l2, l1 / (l1 + l2), "auto"
    else:
        reg, net, solver = alpha * s["d"] / s["n"], 0.0, "normal"
    z = ["z_" + c for c in features]
    stages = [
        VectorAssembler(inputCols=z, outputCol="_features"),
        LinearRegression(featuresCol="_features", labelCol="change", regParam=reg, elasticNetParam=net, solver=solver, standardization=True),
    ]
    fitted = Pipeline(stages=stages).fit(_inputs(scaling.apply(rows), features))
    weights = dict(zip(features, fitted.stages[-1].coefficients.toArray().tolist()))
    return ChangeModel(features, fitted, scaling, weights)


def fit_trees(
    train: DataFrame, features: list[str], loss: str = "absolute", trees: int = 10, depth: int = 3, step: float = 0.1, seed: int = 42, known: tuple[Scaling, dict] | None = None
) -> ChangeModel:
    """Boosted trees; a feature's importance includes its missing flag's."""
    rows = target_change(train)
    scaling = (known or prepared(train, features))[0].of(features)
    inputs = ["z_" + c for c in features] + ["miss_" + c for c in features]
    stages = [
        VectorAssembler(inputCols=inputs, outputCol="_features"),
        GBTRegressor(featuresCol="_features", labelCol="change", lossType=loss, maxIter=trees, maxDepth=depth, stepSize=step, seed=seed),
    ]
    fitted = Pipeline(stages=stages).fit(_inputs(scaling.apply(rows), features))
    gains = fitted.stages[-1].featureImportances.toArray()
    weights = {c: float(gains[k] + gains[k + len(features)]) for k, c in enumerate(features)}
    return ChangeModel(features, fitted, scaling, weights)


def weights_frame(df: DataFrame, model: ChangeModel) -> DataFrame:
    """(feature, weight, is_zero), one row per feature."""
    return df.sparkSession.createDataFrame([(f, float(w), w == 0) for f, w in model.weights.items()], "feature string, weight double, is_zero boolean")


def predict_guard(df: DataFrame, prediction: str, expected: int | None = None) -> DataFrame:
    """One row: n_rows, n_bad (null, NaN or infinite), ok."""
    out = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~finite(F.col(prediction))).alias("n_bad"))
    enough = F.col("n_rows") == expected if expected is not None else F.col("n_rows") > 0
    return out.withColumn("ok", enough & (F.col("n_bad") == 0))


def linear_contributions(rows: DataFrame, coefficients: dict[str, float], scaling: DataFrame) -> DataFrame:
    """(feature, mean_abs, mean): coefficient times standardised value over all rows, zero ones dropped."""
    columns = list(coefficients)
    long = rows.select(*columns).unpivot([], columns, "column", "value").join(F.broadcast(scaling), "column")
    weight = F.create_map(*[x for c, w in coefficients.items() for x in (F.lit(c), F.lit(float(w)))])
    z = F.try_divide(F.coalesce("value", "median") - F.col("mean"), F.coalesce(F.nullif("deviation", F.lit(0.0)), F.lit(1.0)))
    part = F.element_at(weight, F.col("column")) * z
    out = long.groupBy(F.col("column").alias("feature")).agg(F.avg(F.abs(part)).alias("mean_abs"), F.avg(part).alias("mean_value"))
    return out.filter("mean_abs > 0")


def change_wape(pred: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    return score_all(pred, by, ("wape_change", "mae"))


#: Folds that are fitted at the same time; each fit is a Spark job of its own.
AT_ONCE = 4


def _each(work: Callable, items: Iterable) -> list:
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(work, items))


def folds_of(tagged: DataFrame) -> list[tuple[int, DataFrame, DataFrame]]:
    """(fold, training rows, validation rows) of rows with fold and fold_side."""
    numbers = sorted(r.fold for r in tagged.select("fold").distinct().collect())
    return [(k, *[tagged.filter((F.col("fold") == k) & (F.col("fold_side") == side)) for side in ("train", "validate")]) for k in numbers]


def _weakest_first(train: DataFrame, features: list[str], step: int, least: int, fit: Callable, see: Callable | None = None) -> list[list[str]]:
    """The sets of features of each round; the ``step`` weakest go from one to the next.  ``see`` gets each round's model."""
    rounds, known = [list(features)], prepared(train, features)
    while True:
        keep = max(least, len(rounds[-1]) - step)
        last = keep == len(rounds[-1])
        if not last or see:
            model = fit(train, rounds[-1], known=known)
        if see:
            see(model)
        if last:
            return rounds
        gone = model.weakest(len(rounds[-1]) - keep)
        rounds.append([f for f in rounds[-1] if f not in gone])


def eliminate(tagged: DataFrame, train: DataFrame, features: list[str], step: int = 1, least: int = 1, fit: Callable = fit_trees) -> DataFrame:
    """(feature, rank, selected, n_features, cv_wape): recursive elimination scored on folds of the training months.

    Every fold eliminates on its own training rows and scores each round on its validation
    rows (WAPE of the change).  The number of features with the least mean is best, of
    equal ones the smaller; which ones they are comes from elimination on all
    training rows.  Selected features rank 1, those removed last 2, and so on;
    n_features and cv_wape are of the smallest set that holds the feature.
    """

    def of_fold(fold) -> dict[int, float]:
        _, fit_on, validate = fold
        curve: dict[int, float] = {}

        def see(model):
            pred = long_predictions(model.predict(validate, "trees"), ("trees",))
            curve[len(model.features)] = score_all(pred, only=("wape_change",)).first().wape_change

        _weakest_first(fit_on, features, step, least, fit, see)
        return curve

    curves = _each(of_fold, folds_of(tagged))
    mean = {n: sum(c[n] for c in curves) / len(curves) for n in curves[0]}
    best = min(mean, key=lambda n: (mean[n], n))
    rounds = _weakest_first(train, features, step, least, fit)
    chosen = next(r for r in rounds if len(r) == best)
    rows = []
    for f in features:
        last = [r for r in rounds if f in r][-1]
        removed_after = sum(len(r) < len(last) and len(r) >= best for r in rounds)
        rows.append((f, 1 if f in chosen else 1 + removed_after, f in chosen, len(last), mean[len(last)]))
    return train.sparkSession.createDataFrame(rows, "feature string, rank int, selected boolean, n_features int, cv_wape double")


def search(tagged: DataFrame, settings: dict[str, dict], prepare: Callable, fit: Callable, seeds: tuple[int, ...] = (1, 2, 3), weights: str = "linear") -> DataFrame:
    """(setting, seed, state, folds, objective, best): each setting on all folds, then the best one again with other seeds.

    ``prepare(train)`` makes what a fold's fits share, ``fit(train, it, seed, **setting)`` a model.  A
    setting that ``fit`` rejects with a ValueError is pruned and has no objective.  The objective is
    ``fold_objective``'s; rows of the re-check have a seed.
    """
    folds = [(k, fit_on, validate, prepare(fit_on)) for k, fit_on, validate in folds_of(tagged)]

    def ratios(fold, tries: dict[str, tuple[dict, int | None]]) -> dict[str, float | None]:
        """Each try's MAE over persistence's on a fold, all in one pass; None for a rejected one."""
        k, fit_on, validate, shared = fold
        rows, fitted = lag_average(validate, training_median(fit_on), 1, "persistence"), []
        for n, (setting, seed) in enumerate(tries.values()):
            try:
                rows = fit(fit_on, shared, seed, **setting).predict(rows, f"try_{n}")
                fitted.append(f"try_{n}")
            except ValueError:
                continue
        mae = {r.model: r.mae for r in score_all(long_predictions(rows, ("persistence", *fitted)), only=("mae",)).collect()}
        if not mae["persistence"]:
            raise RuntimeError(f"persistence has no error on fold {k}, so ratios to it are infinite")
        return {name: mae[f"try_{n}"] / mae["persistence"] if f"try_{n}" in mae else None for n, name in enumerate(tries)}

    def objectives(tries) -> dict[str, float | None]:
        w = [float(k) if weights == "linear" else 1.0 for k, *_ in folds]
        found = _each(lambda fold: ratios(fold, tries), folds)
        return {name: None if any(f[name] is None for f in found) else sum(x * f[name] for x, f in zip(w, found)) / sum(w) for name in tries}

    tried = objectives({name: (s, None) for name, s in settings.items()})
    complete = {name: x for name, x in tried.items() if x is not None}
    if not complete:
        raise RuntimeError("every setting was rejected")
    best = min(complete, key=lambda n: (complete[n], n))
    rows = [(n, None, "pruned" if x is None else "complete", 0 if x is None else len(folds), x, n == best) for n, x in tried.items()]
    rows += [(best, seed, "complete", len(folds), x, True) for seed, x in objectives({seed: (settings[best], seed) for seed in seeds}).items()]
    return tagged.sparkSession.createDataFrame(rows, "setting string, seed int, state string, folds int, objective double, best boolean")


def fold_ratios(pred: DataFrame, reference: str = "persistence", weights: str = "linear") -> DataFrame:
    """(model, fold, ratio, weight): MAE over the reference's per fold; weights grow with the fold or are equal and add up to 1.

    A fold on which the reference has no error is an error: its ratios would be infinite.
    """
    # Kept, or the errors would be made once for each use below.
    mae = kept(score_all(pred, ("fold", "model"), ("mae",)))
    ref = mae.filter(F.col("model") == reference).select("fold", F.col("mae").alias("ref"))
    out = mae.filter(F.col("model") != reference).join(F.broadcast(ref), "fold")
    w = F.col("fold").cast("double") if weights == "linear" else F.lit(1.0)
    ratio = F.when(F.col("ref") > 0, F.col("mae") / F.col("ref")).otherwise(F.raise_error(F.lit("the reference has no error on a fold")).cast("double"))
    out = out.withColumn("ratio", ratio).withColumn("w", w)
    total = out.groupBy("model").agg(F.sum("w").alias("total"))
    return out.join(F.broadcast(total), "model").select("model", "fold", "ratio", (F.col("w") / F.col("total")).alias("weight"))


def fold_objective(ratios: DataFrame) -> DataFrame:
    """(model, objective, folds): the weighted mean ratio; a fold without a ratio makes it null."""
    whole = F.count_if(F.col("ratio").isNull()) == 0
    return ratios.groupBy("model").agg(F.when(whole, F.sum(F.col("ratio") * F.col("weight"))).alias("objective"), F.count(F.lit(1)).alias("folds"))
