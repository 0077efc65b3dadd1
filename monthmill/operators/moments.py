"""Linear models on folds from moments: one reading of the rows serves every fold, penalty and set of features.

A month's rows give one matrix of products of (1, values, missing flags, label).  Matrices
add up over a fold's training months, and because the flags are in them, each fold's own
medians are put in for missing values afterwards.  What reaches the driver is a matrix and medians per
fold, whatever the number of rows.  NaN and infinite values count as missing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import finite
from ..sources.panel import LAST, TARGET, TIME
from .models import fold_objective, fold_ratios, target_change
from .ordered import ACCURACY, quantile_columns
from .scoring import score_all

#: Deviations at or below this share of a column's overall deviation are rounding: the column is constant.
CONSTANT = 1e-7


@dataclass(frozen=True)
class FoldMoments:
    """A fold's training rows: number, label's mean, and of the imputed features medians, means, deviations, correlations and covariances with the label.

    A feature that no row misses needs no median; 0 stands for it.
    """

    fold: int
    n: int
    label: float
    medians: np.ndarray
    means: np.ndarray
    deviations: np.ndarray
    products: np.ndarray
    slopes: np.ndarray


def _known(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(finite(F.col(c).cast("double")), F.col(c).cast("double")) for c in features})


def _medians(rows: DataFrame, training: DataFrame, features: list[str]) -> dict[tuple[int, str], float]:
    """Exact medians by fold and column, in two readings; columns without a value in a fold are absent.

    As in ``exact_quantiles``, an approximate bracket holds the rows in question: rows below it are counted, those inside by value.
    Columns stay beside each other, so that a row is not one per column; only what lies in a bracket is.
    """
    tagged = rows.select(TIME, *features).join(F.broadcast(training), TIME)
    reach = 2 / ACCURACY
    ends = F.array(F.lit(0.5 - reach), F.lit(0.5 + reach))
    rough = tagged.groupBy("fold").agg(
        *[F.percentile_approx(c, ends, ACCURACY).alias(f"e_{c}") for c in features], *[F.count(c).alias(f"n_{c}") for c in features],
        *[F.min(c).alias(f"a_{c}") for c in features], *[F.max(c).alias(f"z_{c}") for c in features],
    )
    known: dict[tuple[int, str], tuple[int, float, float]] = {}
    for r in rough.collect():
        for c in features:
            if r[f"n_{c}"]:
                # Where a bracket's reach is less than a row or two, everything lies inside.
                known[r.fold, c] = (r[f"n_{c}"], *((r[f"a_{c}"], r[f"z_{c}"]) if r[f"n_{c}"] <= ACCURACY else r[f"e_{c}"]))
    days: dict[int, list[int]] = {}
    for r in training.select("fold", F.unix_date(TIME).alias("day")).collect():
        days.setdefault(r.fold, []).append(r.day)

    read = _reader()

    def counted(batches):
        for batch in batches:
            day, columns = read(batch, len(features))
            for fold, of_fold in days.items():
                here = np.isin(day, of_fold)
                for k, c in enumerate(features):
                    if (fold, c) in known:
                        _, low, high = known[fold, c]
                        x = columns[k][here]
                        values, t = np.unique(x[(x >= low) & (x <= high)], return_counts=True)
                        # Everything below a bracket is one value, null, to its counts.
                        at = pa.array([None, *values.tolist()], pa.float64())
                        yield pa.RecordBatch.from_arrays([pa.array([fold] * len(at), pa.int32()), pa.array([c] * len(at)), at, pa.array([int((x < low).sum()), *t.tolist()], pa.int64())], names=["fold", "c", "v", "t"])

    counts = rows.select(F.unix_date(TIME), *features).mapInArrow(counted, "fold int, c string, v double, t long").groupBy("fold", "c", "v").agg(F.sum("t").alias("t"))
    upto = F.sum("t").over(Window.partitionBy("fold", "c").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    sizes = rows.sparkSession.createDataFrame([(fold, c, n) for (fold, c), (n, _, _) in known.items()], "fold int, c string, n long")
    ranked = counts.withColumn("upto", upto).join(F.broadcast(sizes), ["fold", "c"])
    first = lambda rank: F.min(F.when(F.col("upto") > rank, F.struct("upto", "v"))).getField("v")
    both = ranked.groupBy("fold", "c").agg(first(F.floor((F.col("n") - 1) / 2)).alias("a"), first(F.ceil((F.col("n") - 1) / 2)).alias("b"))
    return {(r.fold, r.c): r.a if r.a == r.b else 0.5 * r.a + 0.5 * r.b for r in both.collect()}


def _reader():
    """A batch's first column, and the next ``p`` as doubles with NaN for null; made here, so that workers needn't import this module."""

    def columns(batch, p: int) -> tuple[np.ndarray, list[np.ndarray]]:
        get = lambda k: batch.column(k).to_numpy(zero_copy_only=False)
        return get(0), [get(k + 1).astype(float) for k in range(p)]

    return columns


def _matrices(rows: DataFrame, training: DataFrame, features: list[str], centre: np.ndarray, unit: np.ndarray) -> dict[int, np.ndarray]:
    """A fold's sums of products: a task adds up a matrix per month, and these meet by fold and row of the matrix."""
    p = len(features)
    size = 2 * p + 2

    read = _reader()

    def products(batches):
        sums: dict[object, np.ndarray] = {}
        for batch in batches:
            month, given = read(batch, p + 1)
            x = np.stack(given[:p], axis=1)
            gone = np.isnan(x)
            values = np.where(gone, 0.0, (x - centre) / unit)
            vector = np.hstack([np.ones((len(x), 1)), values, gone, given[p][:, None]])
            for m in np.unique(month):
                part = vector[month == m]
                sums[m] = sums.get(m, 0.0) + part.T @ part
        for m, matrix in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([int(m)] * size, pa.int32()), pa.array(range(size), pa.int32()), *[pa.array(matrix[:, j]) for j in range(size)]], names=columns)

    columns = ["day", "i", *[f"s{j}" for j in range(size)]]
    schema = "day int, i int, " + ", ".join(f"s{j} double" for j in range(size))
    months = rows.select(F.unix_date(TIME), *features, "change").mapInArrow(products, schema)
    by_day = training.select(F.unix_date(TIME).alias("day"), "fold")
    sums = months.join(F.broadcast(by_day), "day").groupBy("fold", "i").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(size)])
    found: dict[int, np.ndarray] = {}
    for r in sums.collect():
        found.setdefault(r.fold, np.zeros((size, size)))[r.i] = [r[f"s{j}"] for j in range(size)]
    return found


def fold_moments(rows: DataFrame, months: DataFrame, features: list[str]) -> list[FoldMoments]:
    """Moments of the change on each fold's training rows.

    ``rows``: a row per user and month with the features and target; those without a change don't
    train.  ``months``: ``splits.fold_months``.  A column without values in a fold is
    0 there; a constant one has deviation 0.  Folds without training rows are absent.
    """
    names = [f"f{k}" for k in range(len(features))]
    rows = _known(rows.select(TIME, TARGET, LAST, *[F.col(c).alias(n) for c, n in zip(features, names)]), names)
    absent = rows.agg(*[F.count_if(F.isnull(n)).alias(n) for n in names]).first()
    rows = target_change(rows)
    training = months.filter("fold_side = 'train'").select(TIME, "fold")
    # Values near 0 keep the sums' digits; any centre and unit give the same model.
    about = rows.agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"d_{n}") for n in names]).first()
    centre = np.array([about[f"m_{n}"] or 0.0 for n in names])
    unit = np.array([about[f"d_{n}"] or 1.0 for n in names])
    gaps = [n for n in names if absent[n]]
    medians = _medians(rows, training, gaps) if gaps else {}
    p, found = len(names), []
    for fold, sums in sorted(_matrices(rows, training, names, centre, unit).items()):
        middle = np.array([medians.get((fold, n), 0.0) for n in names])
        # (1, values, flags, label) to (1, imputed values, label).
        fill = np.zeros((p + 2, 2 * p + 2))
        fill[0, 0] = fill[p + 1, 2 * p + 1] = 1.0
        fill[1 : p + 1, 1 : p + 1] = np.eye(p)
        fill[1 : p + 1, p + 1 : 2 * p + 1] = np.diag((middle - centre) / unit)
        full = fill @ sums @ fill.T
        n, mean = full[0, 0], full[0] / full[0, 0]
        spread = full / n - np.outer(mean, mean)
        deviation = np.sqrt(np.maximum(np.diag(spread)[1:-1], 0.0))
        deviation[deviation <= CONSTANT] = 0.0
        by = np.where(deviation > 0, deviation, 1.0)
        alive = np.outer(deviation > 0, deviation > 0)
        products, slopes = np.where(alive, spread[1:-1, 1:-1] / np.outer(by, by), 0.0), np.where(deviation > 0, spread[1:-1, -1] / by, 0.0)
        found.append(FoldMoments(fold, round(n), mean[-1], middle, mean[1:-1] * unit + centre, deviation * unit, products, slopes))
    return found


def ridge(m: FoldMoments, alpha: float, chosen: np.ndarray | None = None) -> np.ndarray:
    """Weights of the standardised features, summed squares + alpha * sum of squared weights; those not ``chosen`` are 0.

    Without a penalty, directions that the rows don't span get no weight.
    """
    if alpha < 0:
        raise ValueError(f"alpha must not be negative, not {alpha}")
    use = m.deviations > 0 if chosen is None else (m.deviations > 0) & chosen
    weights = np.zeros(len(use))
    if use.any():
        values, directions = np.linalg.eigh(m.products[np.ix_(use, use)])
        over = values + alpha / m.n
        kept = over > 1e-12 * max(values[-1], 1.0)
        weights[use] = directions[:, kept] @ ((directions[:, kept].T @ m.slopes[use]) / over[kept])
    return weights


def elastic_net(m: FoldMoments, alpha: float, l1_ratio: float, sweeps: int = 100_000) -> np.ndarray:
    """Weights of the standardised features, mean squares / 2 + alpha * (l1_ratio * |w| + (1 - l1_ratio) / 2 * w^2).

    Coordinate descent finds the signs; with them, the weights solve a linear system, and it
    ends when that solution keeps the signs and no other feature wants in.
    """
    if alpha < 0 or not 0 <= l1_ratio <= 1:
        raise ValueError(f"alpha must not be negative and l1_ratio lie in [0, 1], not {alpha} and {l1_ratio}")
    l1, l2, live = alpha * l1_ratio, alpha * (1 - l1_ratio), np.flatnonzero(m.deviations > 0)
    w = np.zeros(len(m.deviations))
    slack = 1e-9 * max(float(np.abs(m.slopes).max(initial=0.0)), 1e-300)
    for sweep in range(sweeps):
        moved = 0.0
        for j in live:
            rest = m.slopes[j] - m.products[j] @ w + m.products[j, j] * w[j]
            new = np.sign(rest) * max(abs(rest) - l1, 0.0) / (m.products[j, j] + l2)
            moved, w[j] = max(moved, abs(new - w[j])), new
        on = np.flatnonzero(w)
        if sweep % 10 == 0 or moved <= slack:
            exact = np.zeros_like(w)
            exact[on] = np.linalg.lstsq(m.products[np.ix_(on, on)] + l2 * np.eye(len(on)), m.slopes[on] - l1 * np.sign(w[on]), rcond=None)[0]
            pull = m.slopes - m.products @ exact - l2 * exact
            right = np.abs(pull[on] - l1 * np.sign(w[on])).max(initial=0.0) <= slack
            if right and (np.sign(exact) == np.sign(w)).all() and (np.abs(pull) <= l1 + slack).all():
                return exact
        if moved <= 1e-6 * slack:
            break
    return w


#: A family's fit by its parameters.
FAMILIES = {"ridge": ridge, "elastic_net": elastic_net}


def fold_predictions(rows: DataFrame, months: DataFrame, features: list[str], moments: list[FoldMoments], weights: dict[str, dict[int, np.ndarray]]) -> DataFrame:
    """(fold, model, truth, prediction, anchor) of the validation rows: every model of ``weights`` (by fold) and persistence, in one reading.

    A task multiplies its rows of a fold by the weights of all that fold's models.
    """
    spark, p = rows.sparkSession, len(features)
    names = [f"_f{k}" for k in range(p)]
    fits: dict[int, tuple] = {}
    models = ["persistence", *weights]
    for m in moments:
        found = [(k, of_fold[m.fold]) for k, of_fold in enumerate(weights.values(), 1) if m.fold in of_fold]
        raw = np.array([w / np.where(m.deviations > 0, m.deviations, 1.0) for _, w in found]).reshape(len(found), p)
        fits[m.fold] = ([k for k, _ in found], raw, m.label - raw @ m.means, m.medians)

    read = _reader()

    def predicted(batches):
        for batch in batches:
            fold, given = read(batch, p + 3)
            truth, anchor, middle, x = *given[:3], np.stack(given[3:], axis=1)
            for f in np.unique(fold):
                here = fold == f
                numbers, raw, base, medians = fits[f]
                own = np.where(np.isnan(x[here]), medians, x[here])
                change, known = own @ raw.T + base, ~np.isnan(anchor[here])
                naive = np.where(known, anchor[here], middle[here])
                value = np.hstack([naive[:, None], np.where(known[:, None], np.where(known, anchor[here], 0.0)[:, None] + change, change)])
                n, width = value.shape
                with_null = lambda v: pa.array(np.repeat(v, width), from_pandas=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n * width, f, dtype=np.int32)), pa.array(np.tile(np.array([0, *numbers], dtype=np.int32), n)), with_null(truth[here]), pa.array(value.ravel(), from_pandas=True), with_null(anchor[here])],
                    names=["fold", "no", "truth", "prediction", "anchor"],
                )

    known = rows.select(TIME, F.col(TARGET).cast("double").alias("truth"), F.col(LAST).cast("double").alias("anchor"), *[F.col(c).alias(n) for c, n in zip(features, names)])
    known = _known(known, names)
    target = quantile_columns(known.join(F.broadcast(months.filter("fold_side = 'train'")), TIME), "truth", {"_middle": 0.5}, ("fold",))
    held = known.join(F.broadcast(months.filter("fold_side = 'validate'").select(TIME, "fold")), TIME).join(F.broadcast(target), "fold").filter(F.col("fold").isin(*fits))
    held = held.filter("anchor IS NULL OR NOT isnan(anchor)")  # no model has a usable prediction there
    made = held.select("fold", "truth", "anchor", "_middle", *names).mapInArrow(predicted, "fold int, no int, truth double, prediction double, anchor double")
    named = spark.createDataFrame(list(enumerate(models)), "no int, model string")
    return made.join(F.broadcast(named), "no").select("fold", "model", "truth", "prediction", "anchor")


def search_linear(rows: DataFrame, months: DataFrame, features: list[str], settings: dict[str, dict], weights: str = "linear") -> DataFrame:
    """(setting, family, alpha, l1_ratio, state, folds, objective, best): linear models of all settings on all folds.

    A setting names its ``family`` and that family's parameters.  The objective is
    ``fold_objective``'s; settings that the family rejects are pruned and have none.
    ``best`` is the least objective of each family; of those equal to nine digits, the first by
    name.  Rows are read for the moments and once more for all errors.
    """
    moments = fold_moments(rows, months, features)
    found: dict[str, dict[int, np.ndarray]] = {}
    for name, setting in settings.items():
        fit = FAMILIES[setting["family"]]
        try:
            found[name] = {m.fold: fit(m, **{k: v for k, v in setting.items() if k != "family"}) for m in moments}
        except ValueError:
            continue
    if not found:
        raise RuntimeError("every setting was rejected")
    scored = fold_objective(fold_ratios(fold_predictions(rows, months, features, moments, found), weights=weights)).withColumnRenamed("model", "setting")
    listed = [(n, s["family"], float(s["alpha"]), s.get("l1_ratio"), "complete" if n in found else "pruned") for n, s in settings.items()]
    told = rows.sparkSession.createDataFrame(listed, "setting string, family string, alpha double, l1_ratio double, state string")
    order = Window.partitionBy("family").orderBy(F.round("objective", 9).asc_nulls_last(), "setting")
    out = told.join(F.broadcast(scored), "setting", "left").withColumn("folds", F.coalesce("folds", F.lit(0)))
    return out.withColumn("best", (F.row_number().over(order) == 1) & F.col("objective").isNotNull()).select(
        "setting", "family", "alpha", "l1_ratio", "state", "folds", "objective", "best"
    )


def eliminate_linear(rows: DataFrame, months: DataFrame, features: list[str], alpha: float, step: int = 1, least: int = 1) -> DataFrame:
    """(fold, n_features, wape, dropped): recursive elimination by ridge weights on every fold, all rounds from the fold's one matrix.

    The ``step`` features with the least absolute weight go after each round, of equal ones the
    first by name; ``dropped`` names them in order (none after the last round).  ``wape`` is that of
    the change on the fold's validation rows.
    """
    if step < 1 or not 1 <= least <= len(features):
        raise ValueError(f"step must be positive and least between 1 and {len(features)}, not {step} and {least}")
    moments = fold_moments(rows, months, features)
    weights: dict[str, dict[int, np.ndarray]] = {}
    dropped = []
    for m in moments:
        chosen = np.ones(len(features), dtype=bool)
        while True:
            w, left = ridge(m, alpha, chosen), int(chosen.sum())
            weights.setdefault(str(left), {})[m.fold] = w
            gone = sorted(np.flatnonzero(chosen), key=lambda j: (abs(w[j]), features[j]))[: min(step, left - least)]
            dropped.append((m.fold, left, [features[j] for j in gone]))
            if not gone:
                break
            chosen[gone] = False
    pred = fold_predictions(rows, months, features, moments, weights).filter("model <> 'persistence'")
    wape = score_all(pred, ("fold", "model"), ("wape_change",)).select("fold", F.col("model").cast("int").alias("n_features"), F.col("wape_change").alias("wape"))
    told = rows.sparkSession.createDataFrame(dropped, "fold int, n_features int, dropped array<string>")
    return told.join(F.broadcast(wape), ["fold", "n_features"], "left").select("fold", "n_features", "wape", "dropped")
