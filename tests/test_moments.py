"""Linear models from moments, elimination and drawn settings against NumPy."""

import math
from datetime import date

import numpy as np
import pytest

from monthmill.operators import models, moments, splits
from monthmill.operators.candidates import Span, draw, share
from monthmill.sources import panel as P

NAMES = ["f0", "f1", "f2", "f3", "still", "void"]
SCHEMA = f"user_id string, month date, {', '.join(f'{n} double' for n in NAMES)}, {P.LAST} double, {P.TARGET} double"


def made(months=16, users=9, seed=3):
    """f1 nearly repeats f0, f2 has gaps of all kinds, f3 says nothing, ``still`` is constant, ``void`` has no value."""
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(users):
        for k in range(months):
            a, b, c, d = rng.normal(size=4) * [5, 1, 300, 1] + [1e4, 0, -50, 2]
            change = 4 * (a - 1e4) - 0.02 * c + rng.normal() * 8
            gap = {0: None, 1: float("nan"), 2: float("inf")}.get(int(rng.integers(0, 12)), float(c))
            last = None if (u + k) % 17 == 0 else 500.0 + 10 * u
            rows.append((f"u{u}", date(2020 + k // 12, k % 12 + 1, 1), float(a), float(a + 0.1 * b), gap, float(d), 7.0, None, last, None if (u * k) % 41 == 40 else 500.0 + 10 * u + float(change)))
    return rows + rows[:5]  # repeats count


def brute(rows, months, features):
    """By fold: (imputed and standardised training features, label, the same of the validation rows, their truth, anchor and the fold's median target)."""
    at = [NAMES.index(f) + 2 for f in features]
    side = {(r.month, r.fold): r.fold_side for r in months.collect()}
    found = {}
    for k in sorted({f for _, f in side}):
        pick = lambda which: [r for r in rows if side.get((r[1], k)) == which]  # noqa: B023, E731
        clean = lambda rs: np.array([[np.nan if r[i] is None or not math.isfinite(r[i]) else r[i] for i in at] for r in rs]).reshape(len(rs), len(at))
        train = [r for r in pick("train") if r[-1] is not None and r[-2] is not None]
        x, held = clean(train), pick("validate")
        middle = np.array([np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else 0.0 for c in x.T])
        fill = lambda m: np.where(np.isnan(m), middle, m)  # noqa: B023, E731
        mean, dev = fill(x).mean(0), fill(x).std(0)
        dev = np.where(dev > 1e-9, dev, 0.0)
        z = lambda m: (fill(m) - mean) / np.where(dev > 0, dev, 1.0) * (dev > 0)  # noqa: B023, E731
        found[k] = (z(x), np.array([r[-1] - r[-2] for r in train]), z(clean(held)), held, np.median([r[-1] for r in pick("train") if r[-1] is not None]))
    return found


def errors(side, weights):
    """(MAE of the model, of persistence, share of the change that is missed) on a fold's validation rows."""
    _, y, z, held, middle = side
    change = y.mean() + z @ weights
    own, naive, size, moved = [], [], [], []
    for c, r in zip(change, held):
        if r[-1] is None:
            continue
        own.append(abs(r[-1] - ((r[-2] or 0.0) + c)))
        naive.append(abs(r[-1] - (middle if r[-2] is None else r[-2])))
        if r[-2] is not None:
            size.append(own[-1])
            moved.append(abs(r[-1] - r[-2]))
    return np.mean(own), np.mean(naive), sum(size) / sum(moved)


def closed(z, y, alpha):
    live = z.std(0) > 0
    w = np.zeros(z.shape[1])
    w[live] = np.linalg.solve(z[:, live].T @ z[:, live] + alpha * np.eye(live.sum()), z[:, live].T @ (y - y.mean()))
    return w


@pytest.fixture(scope="module")
def case(spark):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).persist()
    months = splits.fold_months(df, folds=3).persist()
    return rows, df, months, moments.fold_moments(df, months, NAMES), brute(rows, months, NAMES)


def test_weights_of_all_folds(spark, case):
    _, df, months, found, want = case
    assert [m.fold for m in found] == sorted(want) == [1, 2, 3]
    for m in found:
        z, y, *_ = want[m.fold]
        assert m.n == len(y) and m.label == pytest.approx(y.mean()) and m.deviations[4] == m.deviations[5] == 0
        for alpha in (0.5, 30.0, 1e5):
            assert moments.ridge(m, alpha) == pytest.approx(closed(z, y, alpha), rel=1e-6, abs=1e-9)
        for alpha, ratio in ((0.01, 0.05), (0.5, 0.5), (3.0, 1.0), (2.0, 0.0), (1e6, 0.7)):
            w = moments.elastic_net(m, alpha, ratio)
            slope = z.T @ (y - y.mean() - z @ w) / len(y) - alpha * (1 - ratio) * w
            on = w != 0
            assert slope[on] == pytest.approx(alpha * ratio * np.sign(w[on]), abs=1e-6) and (np.abs(slope) <= alpha * ratio + 1e-6)[m.deviations > 0].all()
        assert not moments.elastic_net(m, 1e6, 0.7).any()


def test_same_weights_as_the_library(spark, case):
    _, df, months, found, _ = case
    clean = ["f0", "f1", "f3"]
    at = [NAMES.index(c) for c in clean]
    rows = df.join(months.filter("fold = 2 AND fold_side = 'train'"), "month")
    ours = moments.ridge(found[1], 5.0, np.isin(np.arange(len(NAMES)), at))[at]
    theirs = models.fit_linear(rows, clean, 5.0).weights
    assert ours == pytest.approx([theirs[c] for c in clean], rel=1e-6)


def test_predictions_and_objectives(spark, case):
    _, df, months, found, want = case
    settings = {"r": {"family": "ridge", "alpha": 3.0}, "strong": {"family": "ridge", "alpha": 1e7}, "bad": {"family": "ridge", "alpha": -1.0}, "e": {"family": "elastic_net", "alpha": 0.2, "l1_ratio": 0.4}, "odd": {"family": "elastic_net", "alpha": 0.2, "l1_ratio": 1.4}}
    got = {r.setting: r for r in moments.search_linear(df, months, NAMES, settings).collect()}
    assert set(got) == set(settings) and {n for n, r in got.items() if r.state == "pruned"} == {"bad", "odd"}
    assert got["bad"].objective is None and got["bad"].folds == 0 and {n for n, r in got.items() if r.best} == {"r", "e"}
    for name, fit in (("r", lambda k: closed(*want[k][:2], 3.0)), ("strong", lambda k: closed(*want[k][:2], 1e7)), ("e", lambda k: moments.elastic_net(found[k - 1], 0.2, 0.4))):
        ratio = {k: (lambda a, b, _: a / b)(*errors(want[k], fit(k))) for k in want}
        assert got[name].folds == 3 and got[name].objective == pytest.approx(sum(k * r for k, r in ratio.items()) / 6, rel=1e-9)
    equal = {r.setting: r.objective for r in moments.search_linear(df, months, NAMES, {"r": settings["r"]}, weights="equal").collect()}
    ratio = [(lambda a, b, _: a / b)(*errors(want[k], closed(*want[k][:2], 3.0))) for k in want]
    assert equal["r"] == pytest.approx(np.mean(ratio), rel=1e-9)
    with pytest.raises(RuntimeError):
        moments.search_linear(df, months, NAMES, {"bad": settings["bad"]})


def test_elimination(spark, case):
    _, df, months, _, want = case
    got = {(r.fold, r.n_features): r for r in moments.eliminate_linear(df, months, NAMES, 10.0, step=2, least=1).collect()}
    assert {n for _, n in got} == {6, 4, 2, 1} and len(got) == 12
    for k, side in want.items():
        z, y, *_ = side
        left = list(range(len(NAMES)))
        while True:
            w = np.zeros(len(NAMES))
            w[left] = closed(z[:, left], y, 10.0)
            row = got[k, len(left)]
            assert row.wape == pytest.approx(100 * errors(side, w)[2], rel=1e-9)
            gone = sorted(left, key=lambda j: (abs(w[j]), NAMES[j]))[: min(2, len(left) - 1)]
            assert row.dropped == [NAMES[j] for j in gone]
            if not gone:
                break
            left = [j for j in left if j not in gone]
        assert got[k, 6].dropped == ["still", "void"]  # ties by name
    for step, least in ((0, 1), (1, 0), (1, 7)):
        with pytest.raises(ValueError):
            moments.eliminate_linear(df, months, NAMES, 10.0, step, least)


def test_clashing_names_and_rows_without_labels(spark, case):
    rows, df, months, found, _ = case
    other = df.withColumnsRenamed({"f0": "change", "f1": "fold", "f2": "f1", "f3": "model"}).withColumn("fold_side", months.select("fold_side").schema and moments.F.lit("x"))
    names = ["change", "fold", "f1", "model", "still", "void"]
    again = moments.fold_moments(other, months, names)
    for a, b in zip(found, again):
        assert moments.ridge(a, 3.0) == pytest.approx(moments.ridge(b, 3.0), rel=1e-9)
    setting = {"r": {"family": "ridge", "alpha": 3.0}}
    x, y = [moments.search_linear(d, months, n, setting).first().objective for d, n in ((df, NAMES), (other, names))]
    assert x == pytest.approx(y, rel=1e-12)
    for empty in (df.withColumn(P.TARGET, moments.F.lit(None).cast("double")), df.limit(0)):
        assert moments.fold_moments(empty, months, NAMES) == []
        row = moments.search_linear(empty, months, NAMES, setting).first()
        assert row.objective is None and row.folds == 0 and not row.best
        assert moments.eliminate_linear(empty, months, NAMES, 1.0).count() == 0
    flat = df.withColumn(P.TARGET, moments.F.col(P.LAST))
    with pytest.raises(Exception, match="no error on a fold"):
        moments.search_linear(flat, months, NAMES, setting).collect()


def test_no_penalty_and_a_repeated_column(spark, case):
    _, df, months, _, _ = case
    for m in moments.fold_moments(df.withColumn("twin", moments.F.col("f0")), months, ["f0", "twin", "f3"]):
        w = moments.ridge(m, 0.0)
        assert w[0] == pytest.approx(w[1], rel=1e-6) and np.isfinite(w).all()
        lasso = moments.elastic_net(m, 1.0, 1.0)
        assert lasso[0] + lasso[1] == pytest.approx(moments.elastic_net(m, 1.0, 0.999999)[:2].sum(), rel=1e-4)


def test_drawn_settings():
    space = {"alpha": Span(0.01, 1e6, log=True), "depth": Span(3, 6), "trees": Span(100, 600, log=True), "rate": Span(0.5, 1.0), "loss": ("absolute", "squared", "huber")}
    got = draw("trees", space, 400, kind="x")
    assert got == draw("trees", space, 400, kind="x") and list(got)[:2] == ["trees_000", "trees_001"] and all(s["kind"] == "x" for s in got.values())
    assert draw("trees", space, 50) != draw("trees", space, 50, seed=1) and list(draw("t", space, 2)) == ["t_00", "t_01"]
    assert {s["depth"] for s in got.values()} == {3, 4, 5, 6} and {s["loss"] for s in got.values()} == set(space["loss"])
    assert all(0.01 <= s["alpha"] < 1e6 and 0.5 <= s["rate"] < 1.0 and 100 <= s["trees"] <= 600 and isinstance(s["trees"], int) for s in got.values())
    assert 0.4 < np.mean([s["alpha"] < 100 for s in got.values()]) < 0.6  # half of the decades
    assert Span(3, 6).at(1 - 2**-53) == 6 and Span(3, 6).at(0.0) == 3 and Span(1, 8, log=True).at(1 - 2**-53) == 8
    assert 0 <= min(share(1, "s", k, "p") for k in range(100)) and max(share(1, "s", k, "p") for k in range(100)) < 1
    for low, high, log in ((1, 1, False), (2, 1, False), (0.0, 1.0, True)):
        with pytest.raises(ValueError):
            Span(low, high, log)
    for n, bad in ((0, space), (1, {"loss": ()})):
        with pytest.raises(ValueError):
            draw("s", bad, n)


def test_fold_months_read_no_rows(spark):
    rows = spark.range(400).selectExpr("add_months(date'2015-01-01', int(id % 40)) AS month")
    months = splits.fold_months(rows)
    plan = months._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan and "Exchange" not in plan
    assert {(r.fold, r.fold_side) for r in months.collect()} == {(k, s) for k in range(1, 6) for s in ("train", "validate")}


def test_fold_medians_are_exact(spark):
    """More rows than the approximation is exact for, many of them equal, and a column that a fold lacks."""
    rng = np.random.default_rng(5)
    n, month = 30_000, rng.integers(0, 3, 30_000)
    a, b = rng.normal(0, 1, n), rng.integers(0, 3, n).astype(float)
    a[rng.random(n) < 0.3] = np.nan
    b[month == 0] = np.nan
    day = lambda k: date(2020, int(k) + 1, 1)
    rows = spark.createDataFrame([(day(m), *[None if np.isnan(v) else float(v) for v in x]) for m, *x in zip(month, a, b)], "month date, a double, b double")
    training = spark.createDataFrame([(day(m), fold) for fold in (1, 2, 3) for m in range(fold)], "month date, fold int")
    got = moments._medians(rows, training, ["a", "b"])
    want = {(fold, c): float(np.nanmedian(v[month < fold])) for fold in (1, 2, 3) for c, v in (("a", a), ("b", b)) if (fold, c) != (1, "b")}
    assert got == pytest.approx(want, abs=0, rel=1e-15)
