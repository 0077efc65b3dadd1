"""Hand-written frames: short histories, gaps, nulls, ties, small denominators, broken panels."""

import datetime as dt
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthmill.functions import exprs
from monthmill.operators import features, models, ordered, paired, quality, scoring, segments, serving, splits, validation
from monthmill.sources import panel as P
from monthmill.sources import tables
from monthmill.streaming.serve import Conflict, ServingTables, serve_rows, serve_stream


def month(k):
    return dt.date(2020 + k // 12, k % 12 + 1, 1)


def frame(spark, balances, user="u"):
    """Rows of (month number, last month's balance, the one before)."""
    rows = [(user, month(k), 2020 * 12 + k + 1, b, p, 50.0, 300.0, 200.0, 0.0) for k, b, p in balances]
    return spark.createDataFrame(
        rows, f"user_id string, month date, month_index int, {P.LAGS[0]} double, {P.LAGS[1]} double, {P.NET_FLOW} double, {P.CREDITED} double, {P.DEBITED} double, {P.TARGET} double"
    )


def built(df):
    return {r.month: r for r in segments.assign_all(features.window_features(df)).collect()}


def test_short_history_and_gap(spark):
    rows = built(frame(spark, [(k, 100.0 + k, 99.0 + k) for k in range(8) if k != 5]))
    assert rows[month(4)].roll6_mean_balance is None and rows[month(4)].history_months == 5 and rows[month(4)].history_id == 1
    assert rows[month(7)].history_months == 5 and rows[month(7)].roll6_mean_balance is None  # the gap counts


def test_all_null_balance(spark):
    rows = built(frame(spark, [(k, None, None) for k in range(7)]))
    assert rows[month(6)].history_id == 0 and rows[month(6)].drawdown_6m is None and rows[month(6)].sign_regime_id == 0


def test_constant_small_and_deep(spark):
    flat = built(frame(spark, [(k, 50.0, 50.0) for k in range(7)]))[month(6)]
    assert flat.drawdown_6m == 0.0 and flat.roll6_slope_balance == 0.0 and flat.eom_cv_6m is None and flat.sign_flips_6m == 0
    deep = built(frame(spark, [(k, -5000.0, -5000.0) for k in range(7)]).withColumn(P.CREDITED, F.lit(10.0)).withColumn(P.DEBITED, F.lit(10.0)))[month(6)]
    assert deep.debt_depth_6m is None and deep.sign_regime_id == 3  # too small a turnover to measure
    assert built(frame(spark, [(k, 0.0, 0.0) for k in range(7)]))[month(6)].share_neg_last_6m == 0.0


def test_drawdown_is_capped(spark):
    rows = built(frame(spark, list(zip(range(6), [1000.0, 500.0, 1200.0, 300.0, -4000.0, 0.0], [None, 1000.0, 500.0, 1200.0, 300.0, -4000.0]))))
    assert rows[month(5)].drawdown_6m == 2.0 and rows[month(5)].months_since_sign_flip == 1.0


def test_guarded_ratio(spark):
    df = spark.createDataFrame([(1.0, 100.0), (1.0, 99.99), (1e6, -100.0), (None, 500.0), (float("nan"), 500.0), (1.0, None)], "a double, b double")
    got = [r[0] for r in df.select(exprs.guarded_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [0.01, None, -25.0, None, None, None]


def test_bands():
    with pytest.raises(ValueError):
        segments.by_cuts("s", "x", [2.0, 1.0], [("a", ""), ("b", ""), ("c", "")])
    with pytest.raises(ValueError):
        segments.by_cuts("s", "x", [1.0], [("a", "")])


def test_validation(spark):
    df = frame(spark, [(0, 1.0, 1.0), (0, 2.0, 1.0)])
    with pytest.raises(validation.PanelError):
        validation.validate_panel(df)
    with pytest.raises(validation.PanelError):
        validation.validate_panel(df.drop(P.TARGET))
    with pytest.raises(validation.PanelError):
        validation.validate_panel(df.limit(0))
    with pytest.raises(validation.PanelError):
        validation.coerce_types(df, {P.LAGS[0]: P.TARGET})
    with pytest.raises(validation.PanelError):
        validation.coerce_types(spark.createDataFrame([("u", "x", "1")], "user_id string, month string, v string"))
    with pytest.raises(validation.PanelError):
        validation.select_features(df, features=[P.TARGET])
    assert validation.validate_panel(df.limit(1)).count() == 1


def test_fingerprint_ignores_order_only(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    one = validation.fingerprint(df).first()
    assert one == validation.fingerprint(df.orderBy(F.desc("id"))).first()
    assert one.digest != validation.fingerprint(df.withColumn("x", F.when(F.col("id") == 7, 0).otherwise(F.col("x")))).first().digest
    assert one.digest != validation.fingerprint(df.withColumnRenamed("x", "y")).first().digest


def test_cuts():
    assert splits.cut_positions(43) == (35, 35) and splits.cut_positions(10, 0.2, 1) == (7, 8)
    for bad in ((1, 0.2, 0), (10, 0.0, 0), (10, 0.2, 8), (10, 0.2, -1)):
        with pytest.raises(ValueError):
            splits.cut_positions(*bad)
    assert splits.fold_bounds(12, 5, 3, 0, 6) == [(1, 6, 6, 9), (2, 9, 9, 12)]


def test_scores_of_odd_rows(spark):
    rows = [("m", 5.0, 5.0, None), ("m", 5.0, float("nan"), 1.0), ("m", None, 1.0, 1.0), ("z", 0.0, 0.0, 0.0)]
    got = {r.model: r for r in scoring.score_all(spark.createDataFrame(rows, "model string, truth double, prediction double, anchor double")).collect()}
    assert got["m"].n_rows == 1 and got["m"].r2_level is None and got["m"].n_rows_change == 0 and got["m"].mae_change is None
    assert got["z"].wape is None and got["z"].smape is None and got["z"].mape is None


def test_serving_twice_adds_nothing(spark):
    p = spark.createDataFrame([("a", month(1), 1.0), ("b", month(1), 2.0)], "user_id string, month date, prediction double")
    once = serving.insert_new(p.limit(0), p)
    again = serving.insert_new(once, p.withColumn("prediction", F.lit(9.0)))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, p.collect()))
    cp = serving.advance_checkpoints(spark.createDataFrame([("a", month(3))], "user_id string, last_month date"), p)
    assert {r.user_id: r.last_month for r in cp.collect()} == {"a": month(3), "b": month(1)}


def test_health_and_promotion(spark):
    errors = spark.createDataFrame([(month(k % 3), float(e), 100.0) for k, e in enumerate([10] * 40)], "month date, error double, actual double")
    base = lambda mae, day: spark.createDataFrame([(mae, day)], "baseline_mae double, last_trained date")
    now = F.lit(dt.date(2021, 1, 10))
    reason = lambda e, b: serving.health_check(e, b, now).first().reason
    assert reason(errors, base(5.0, None)) == "decayed" and reason(errors, base(9.5, None)) == "within_tolerance"
    assert reason(errors, base(5.0, dt.date(2021, 1, 8))) == "cooldown" and reason(errors.limit(5), base(5.0, None)) == "too_few_rows"
    assert reason(errors.limit(0), base(5.0, None)) == "too_few_rows"
    s = "basis string, challenger_mae double, challenger_rmse double, challenger_wape double, champion_mae double, champion_rmse double, champion_wape double, champion_rows long"
    cases = [("x", 9, 10, 10, 10, 10, 10, 50), ("x", 9.9, 10, 10, 10, 10, 10, 50), ("x", 9, 11, 10, 10, 10, 10, 50), ("x", 9, 10, 10, 10, 10, 10, 5), ("x", 9, 10, 10, None, None, None, None), ("x", 9, 10, 10, 0, 10, 10, 50)]
    df = spark.createDataFrame([tuple(float(v) if i and i < 7 and v is not None else v for i, v in enumerate(c)) for c in cases], s)
    assert [r.outcome for r in serving.promotion_decision(df).collect()] == ["promote", "reject", "reject", "insufficient_data", "promote", "reject"]


def test_wilcoxon_ties_and_zeros(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", -1.0), ("c", 2.0), ("d", 0.0), ("e", 2.0)], "user_id string, diff_mean double")
    r = paired.wilcoxon(df).first()
    assert (r.w_plus, r.w_minus, r.n) == (8.5, 1.5, 4)
    assert r.p_value == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), abs=1e-6)


def test_ranks_and_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(size=3000).round(2), [5.0] * 400])
    df = spark.createDataFrame([("a", float(x)) for x in values] + [("b", 1.0), ("b", None), ("b", 3.0)], "g string, x double").repartition(5)
    got = {(r.g, r.point): (r.n, r.q) for r in ordered.exact_quantiles(df, "x", (0.0, 0.025, 0.5, 0.9, 1.0), ("g",)).collect()}
    for p in (0.0, 0.025, 0.5, 0.9, 1.0):
        assert got["a", p] == (3400, pytest.approx(np.quantile(values, p), abs=1e-12))
        assert got["b", p] == (2, pytest.approx(1 + 2 * p))
    assert ordered.median_row(df.limit(0), F.col("x"), "m").first().m is None
    ranks = {(r.g, r.x): (r.t, r.rank) for r in ordered.average_ranks(df.filter("x IS NOT NULL"), ("g",), "x").collect()}
    order = np.sort(values)
    for x in set(values.tolist()):
        lo, hi = np.searchsorted(order, x, "left"), np.searchsorted(order, x, "right")
        assert ranks["a", x] == (hi - lo, (lo + 1 + hi) / 2)


def test_users_are_numbered_once(spark):
    users = spark.createDataFrame([(g, f"u{i}") for g, n in (("a", 300), ("b", 7)) for i in range(n)], "g string, user_id string")
    got = paired.numbered(users, ("g",)).collect()
    for g, n in (("a", 300), ("b", 7)):
        assert sorted(r.no for r in got if r.g == g) == list(range(n))


def test_suggested_drops():
    assert quality.suggested_drops([("a", "b", 0.99), ("b", "c", -0.95)], {"a": 0.5, "b": 0.1, "c": 0.9}) == ["b"]


def test_future_months_change_nothing(spark):
    rows = [(k, 100.0 * (-1) ** k * k, None) for k in range(9)]
    early, late = built(frame(spark, rows[:7])), built(frame(spark, rows))
    assert all(early[m] == late[m] for m in early)


def test_jdbc_reader_is_lazy(spark):
    with pytest.raises(Exception):
        tables.read_jdbc(spark, "jdbc:none:", "t", ("id", 0, 10)).count()


def test_stream_serves_each_row_once(spark, tmp_path):
    schema = f"user_id string, month date, {P.LAST} double, history_id int"
    source, store = str(tmp_path / "in"), ServingTables(spark, str(tmp_path / "tables"))
    floor = spark.createDataFrame([(month(1),)], "floor_month date")
    put = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
    served = []

    def predict(batch):
        routed = batch.withColumn("route", serving.route()).withColumn("p", F.col(P.LAST))
        served.append(batch.count())
        return serving.routed_predictions(routed, "p", "p")

    def run(checkpoint):
        serve_stream(spark.readStream.schema(schema).parquet(source), predict, store, floor, str(tmp_path / checkpoint)).awaitTermination()
        return sorted((r.user_id, r.month, r.prediction, r.route, r.model_version) for r in store.predictions().collect())

    put([("a", month(2), 5.0, 2), ("b", month(2), None, 2), ("c", month(1), 7.0, 2)])
    first = [("a", month(2), 5.0, "model", "v1")]
    assert run("one") == first and served == [2]  # c is not after the floor
    put([("a", month(2), 9.0, 2), ("a", month(3), 6.0, 0)])
    both = [*first, ("a", month(3), 6.0, "persistence", "v1")]
    assert run("one") == both and served == [2, 1]  # a was served up to its checkpoint
    assert run("again") == both  # a lost checkpoint folder: batch 0 starts over and adds nothing
    assert {r.user_id: r.last_month for r in store.checkpoints().collect()} == {"a": month(3), "b": month(2)}


def test_carry_equals_the_whole_history(spark):
    rng = np.random.default_rng(9)
    rows = [(f"u{u}", month(k), None if rng.random() < 0.15 else float(rng.normal(0, 500))) for u in range(12) for k in range(14) if u < 2 or rng.random() < 0.7]
    rows += [("new", month(13), 5.0), ("gone", month(0), 1.0)] + [(f"u{u}", month(13), 1.0 * u) for u in range(2, 12) if (f"u{u}", month(13)) not in {r[:2] for r in rows}]
    panel = spark.createDataFrame(rows, f"user_id string, month date, {P.TARGET} double")
    carry = spark.createDataFrame([], serving.CARRY)
    for first, behind in ((0, 5), (5, 13), (0, 13), (13, 14)):  # a repeated step changes nothing
        carry = serving.carry_forward(carry, panel.filter(F.col("month").between(month(first), month(behind - 1))))
    key = lambda df: {r.user_id: [round(x, 6) if isinstance(x, float) else x for x in r] for r in df.select(*sorted(df.columns)).collect()}
    assert key(serving.next_month_from_carry(carry)) == key(serving.next_month_panel(panel))
    assert serving.next_month_from_carry(spark.createDataFrame([], serving.CARRY)).count() == 0


def test_windows_of_a_bucketed_table_need_no_exchange(spark, tmp_path, sf_dir):
    rows = P.supplier_panel(spark, sf_dir)
    table = tables.bucketed(rows, "bucketed_panel", str(tmp_path / "t"), buckets=4)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    made = features.feature_table(segments.assign_all(features.window_features(table)))
    assert "Exchange" not in plan(made) and "Exchange" not in plan(table.groupBy(P.ID).count())
    assert "Exchange" in plan(features.window_features(rows))
    assert made.count() == rows.count()
    assert tables.bucketed(rows.limit(3), "bucketed_panel", str(tmp_path / "t"), buckets=4).count() == 3  # replaced
    spark.sql("DROP TABLE bucketed_panel")


def test_signed_ranks_equal_enumeration(spark):
    from itertools import product

    rng = np.random.default_rng(4)
    rows, want = [], {}
    for n in range(1, 13):
        d = rng.permutation(np.arange(1, n + 1)) * rng.choice([-1, 1, 1], n) / 7
        order = np.abs(d).argsort().argsort() + 1
        low = min(order[d > 0].sum(), order[d < 0].sum())
        sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in product((0, 1), repeat=n)]
        want[f"g{n}"] = min(1.0, 2 * sum(s <= low for s in sums) / 2**n)
        rows += [(f"g{n}", float(x)) for x in d] + [(f"g{n}", 0.0)]
    rows += [("ties", 1.0), ("ties", -1.0), ("ties", 2.0)] + [("large", float(x)) for x in range(1, 52)]
    got = {r.g: r for r in paired.wilcoxon(spark.createDataFrame(rows, "g string, diff_mean double"), ("g",)).collect()}
    for g, p in want.items():
        assert got[g].p_exact == pytest.approx(p) and got[g].p_value == got[g].p_exact
    assert got["ties"].p_exact is None and got["large"].p_exact is None and got["ties"].p_value == got["ties"].p_normal


def test_commits_of_two_writers_and_a_crash(spark, tmp_path, monkeypatch):
    schema = f"user_id string, month date, {P.LAST} double, history_id int"
    floor = spark.createDataFrame([(month(1),)], "floor_month date")
    rows = spark.createDataFrame([("a", month(2), 5.0, 2), ("b", month(2), 6.0, 2), ("a", month(3), 7.0, 2)], schema)
    predict = lambda df: serving.routed_predictions(df.withColumn("route", serving.route()).withColumn("p", F.col(P.LAST)), "p", "p")
    store, other = ServingTables(spark, str(tmp_path / "t")), ServingTables(spark, str(tmp_path / "t"))
    state = lambda: (sorted((r.user_id, r.month) for r in store.predictions().collect()), sorted((r.user_id, r.last_month) for r in store.checkpoints().collect()))
    full = ([("a", month(2)), ("a", month(3)), ("b", month(2))], [("a", month(3)), ("b", month(2))])

    with monkeypatch.context() as m:
        m.setattr(store, "_publish", lambda version: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            serve_rows(rows, predict, store, floor)
    assert state() == ([], []) and store.current().number == 0  # files without a commit don't count

    seen = other.current()
    serve_rows(rows, predict, store, floor)
    assert state() == full
    with pytest.raises(Conflict):  # the other writer has read the state before
        other.commit(seen, predict(rows).select("user_id", "prediction", "route", F.lit("v1").alias("model_version"), "month"), store.checkpoints())
    assert state() == full and store.current().number == 1
    serve_rows(rows, predict, other, floor)  # it starts over and finds nothing to add
    assert state() == full and store.current().number == 1


def test_ridge_and_elastic_net_solve_their_problems(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3)) * [1, 10, 100] + [5, 0, -3]
    change = 3 * x[:, 0] - 0.4 * x[:, 1] + rng.normal(size=400)
    names = ["f0", "f1", "f2"]
    rows = [(*map(float, r), 10.0, 10.0 + float(c)) for r, c in zip(x, change)]
    df = spark.createDataFrame(rows, f"f0 double, f1 double, f2 double, {P.LAST} double, {P.TARGET} double")
    z = (x - x.mean(0)) / x.std(0)
    y = change - change.mean()
    ridge = models.fit_linear(df, names, alpha=25.0).weights
    assert [ridge[n] for n in names] == pytest.approx(np.linalg.solve(z.T @ z + 25 * np.eye(3), z.T @ y), rel=1e-6)
    alpha, share = 1.0, 0.5
    w = np.array([models.fit_linear(df, names, alpha, share).weights[n] for n in names])
    # Mean squares / 2 with alpha * (share * |w| + (1 - share) / 2 * w^2).
    slope = z.T @ (y - z @ w) / len(y) - alpha * (1 - share) * w
    assert w[0] > 0 > w[1] and slope[:2] == pytest.approx(alpha * share * np.sign(w[:2]), abs=1e-3)
    assert w[2] == 0 and abs(slope[2]) <= alpha * share
    with pytest.raises(ValueError):
        models.fit_linear(df, names, alpha=-1.0)


def planted(spark, months=30, users=12):
    """A panel whose change is 50 where ``good`` is positive and -50 elsewhere; ``noise`` says nothing."""
    rng = np.random.default_rng(7)
    rows = []
    for u in range(users):
        for k in range(months):
            good, noise = rng.normal(size=2)
            rows.append((f"u{u}", month(k), float(good), float(noise), 100.0, None, None, 100.0 + (50.0 if good > 0 else -50.0), 2 if k > 3 else 0))
    return spark.createDataFrame(rows, f"user_id string, month date, good double, noise double, {P.LAGS[0]} double, {P.LAGS[1]} double, {P.LAGS[2]} double, {P.TARGET} double, history_id int")


def test_trees_find_a_planted_split_and_elimination_keeps_it(spark):
    df = planted(spark).persist()
    tree = models.fit_trees(df, ["noise", "good"], trees=3, depth=2)
    assert tree.weights["good"] > 0.9 and tree.weakest(1) == ["noise"]
    missed = tree.predict(df, "p").agg(F.avg(F.abs(F.col("p") - F.col(P.TARGET)))).first()[0]
    assert missed < 15
    got = {r.feature: r for r in models.eliminate(splits.expanding_folds(df, folds=2), df, ["noise", "good"], fit=lambda d, f, known: models.fit_trees(d, f, trees=2, depth=2, known=known)).collect()}
    assert got["good"].selected and got["good"].rank == 1 and got["good"].n_features == 1
    assert got["noise"].n_features == 2 and got["noise"].rank == (1 if got["noise"].selected else 2)


def test_search_prunes_and_rechecks(spark):
    df = planted(spark, months=14, users=6).persist()
    prepare = lambda rows: models.prepared(rows, ["good", "noise"])
    fit = lambda rows, known, seed, alpha: models.fit_linear(rows, ["good", "noise"], alpha, known=known)
    got = models.search(splits.expanding_folds(df, folds=2), {"weak": {"alpha": 1.0}, "strong": {"alpha": 1e6}, "bad": {"alpha": -1.0}}, prepare, fit, seeds=(1, 2)).collect()
    by = {(r.setting, r.seed): r for r in got}
    assert by["bad", None].state == "pruned" and by["bad", None].objective is None and not by["bad", None].best
    assert by["weak", None].best and by["weak", None].objective < by["strong", None].objective and by["weak", None].folds == 2
    assert by["weak", 1].objective == pytest.approx(by["weak", None].objective) and len(got) == 5
    flat = df.withColumn(P.TARGET, F.col(P.LAST))
    with pytest.raises(RuntimeError):
        models.search(splits.expanding_folds(flat, folds=1), {"weak": {"alpha": 1.0}}, prepare, fit)


def test_a_reference_without_error_is_an_error(spark):
    pred = spark.createDataFrame([(1, "persistence", 1.0, 1.0, 0.0), (1, "m", 1.0, 2.0, 0.0)], "fold int, model string, truth double, prediction double, anchor double")
    with pytest.raises(Exception, match="no error on a fold"):
        models.fold_objective(models.fold_ratios(pred)).collect()


def test_each_route_gets_its_model(spark):
    df = planted(spark, months=8, users=3).withColumn(P.LAST, F.when(F.col("user_id") == "u2", None).otherwise(F.col(P.LAST)))
    model = models.fit_linear(df, ["good"], alpha=1.0)
    rows = model.predict(models.with_baselines(df, df), "ridge").withColumn("route", serving.route())
    for r in serving.routed_predictions(rows, "ridge", "persistence").collect():
        want = {"skip": None, "persistence": r.persistence, "model": r.ridge}[r.route]
        assert r.prediction == want and (r.route == "skip") == (r.user_id == "u2") and (r.route == "persistence") == (r.user_id != "u2" and r.history_id == 0)


def test_cooldown_is_a_span_between_instants(spark):
    errors = spark.createDataFrame([(month(0), 10.0, 100.0)] * 40, "month date, error double, actual double")
    base = spark.createDataFrame([(5.0, "2021-01-07 12:00:00")], "baseline_mae double, last_trained string").withColumn("last_trained", F.col("last_trained").cast("timestamp"))
    for now, reason in (("2021-01-10 11:59:59", "cooldown"), ("2021-01-10 12:00:00", "decayed")):
        assert serving.health_check(errors, base, F.lit(now).cast("timestamp")).first().reason == reason


def test_whales(spark):
    rows = [(f"u{i:03}", month(k), float(min(i, 90))) for i in range(100) for k in range(10)]
    df = spark.createDataFrame(rows, f"user_id string, month date, {P.TARGET} double")
    left = {r.user_id for r in validation.trim_whales(df, P.TARGET, 0.05).select("user_id").distinct().collect()}
    assert left == {f"u{i:03}" for i in range(100)} - {f"u{i:03}" for i in range(90, 95)}  # ten share the largest size
    assert validation.trim_whales(df, P.TARGET, 0.0).count() == len(rows)


def test_restore_level_and_route(spark):
    df = spark.createDataFrame([(1.0, 10.0, 2), (1.0, None, 2), (1.0, 10.0, 0)], f"c double, {P.LAST} double, history_id int")
    assert [r[0] for r in df.select(models.restore_level(F.col("c"), F.col(P.LAST))).collect()] == [11.0, 1.0, 11.0]
    assert [r[0] for r in df.select(serving.route()).collect()] == ["model", "skip", "persistence"]


def test_bootstrap_picks_are_spread_and_never_broadcast(spark):
    """Few users in one partition: picks, 2,000 a user, looked as small to the optimizer as the users, and went through the driver or one task."""
    rows = [("a", "b", str(u), float(u % 7 - 3), 1 + u % 3) for u in range(300)]
    users = spark.createDataFrame(rows, "champion string, challenger string, user_id string, diff_sum double, n long").coalesce(1)
    ci = paired.bootstrap_ci(users, draws=50)
    low, high = ci.select("ci_low", "ci_high").first()
    sums = [(r[3], r[4]) for r in sorted(rows, key=lambda r: (hashlib.md5(r[2].encode()).hexdigest()[:3], r[2]))]
    means = []
    for draw in range(50):
        picked = [sums[int(hashlib.md5(f"{draw}|{place}|{paired.SEED}".encode()).hexdigest()[:8], 16) % 300] for place in range(300)]
        means.append(sum(s for s, _ in picked) / sum(n for _, n in picked))
    assert (low, high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))
    plan = ci._jdf.queryExecution().toString()
    assert "ShuffledHashJoin" in plan and "Range (0, 50" in plan


def test_kept_panels_hold_only_what_is_read(spark, sf_dir):
    from monthmill.plans import frames

    assert set(frames.baselines(frames.segmented(spark, sf_dir), more=("history_id",)).columns) == {
        "user_id", "month", "month_index", "target_closing_balance_usd", *frames.LAGS, "history_id", "side", *frames.BASELINES
    }


def test_a_carrys_mean_is_not_made_for_every_value(spark):
    """A mean inside the lambda of the sum of squares cost a history its square."""
    rows = spark.createDataFrame([("a", month(k), float(k * k)) for k in range(9)], f"user_id string, month date, {P.TARGET} double")
    carry = serving.carry_forward(spark.createDataFrame([], serving.CARRY), rows)
    steps = np.diff([float(k * k) for k in range(9)])
    got = carry.first()
    assert (got.steps, got.step_mean, got.step_m2) == pytest.approx((8, steps.mean(), ((steps - steps.mean()) ** 2).sum()))
    plan = carry._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") <= 3, plan


def test_three_month_deviation_by_value(spark):
    """To the last digit that of mean and squares updated value by value, oldest first, as SQL's frames are; gaps and a null month among them."""

    def by_value(*values):
        n = mean = squares = 0.0
        for x in values:
            if x is not None:
                n, apart = n + 1, x - mean
                mean += apart / n
                squares += (x - mean) * apart
        return math.sqrt(squares / (n - 1)) if n > 1 else None

    rng = np.random.default_rng(3)
    flows = rng.integers(-9_999_999, 9_999_999, (40, 60))
    rows = [(str(u), None if k == 59 else month(k), float(max(x, 0)), float(max(-x, 0))) for u in range(40) for k, x in enumerate(flows[u]) if k == 59 or (u + k) % 11]
    rest = ["n", "nm", "acc", *(f"s{k}" for k in range(7))]
    got = P._with_lags(spark.createDataFrame(rows, "user_id string, m date, cr double, db double").withColumns({c: F.lit(0.0) for c in rest})).collect()
    dated = [r for r in got if r.month]
    assert [r[P.ROLL3[1]] for r in dated] == [by_value(*[r[c] for c in reversed(P.LAGS)]) for r in dated]
    assert sum(r[P.ROLL3[1]] is not None for r in dated) > 1000 and all(r[P.ROLL3[1]] is None for r in got if not r.month)


def test_rows_with_baselines_are_one_reading(spark, sf_dir):
    """The cut and the training median were looked for again, the months by scans of the whole panel, wherever rows were read."""
    from monthmill.plans import frames

    rows = frames.baselines(P.supplier_panel(spark, sf_dir))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("InMemoryRelation") == 1, plan
    empty = splits.holdout_labels(spark.createDataFrame([], f"user_id string, month date, {P.TARGET} double"))
    assert empty.columns[-1] == "side" and not empty.collect()


def test_sizes_of_odd_supplier_numbers(spark, tmp_path):
    """A negative number's remainder pointed before the first size, an error; a missing one had no size.  SQL gives both the last."""
    line = "l_suppkey long, l_partkey long, l_linestatus string, l_returnflag string, l_extendedprice double, l_discount double, l_shipdate timestamp"
    rows = [(k, 1, "O", "N", 4000.0, 0.0, dt.datetime(1997, 3, 5)) for k in (3, 4, 5, -1, -2, -3, None)]
    spark.createDataFrame(rows, line).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.user_id: r[P.TARGET] for r in P.supplier_panel(spark, str(tmp_path)).collect()}
    assert got == {"3": 25.0, "4": 100.0, "5": 300.0, "-1": 300.0, "-2": 300.0, "-3": 25.0, None: 300.0}


def test_buckets_grow_with_the_table(spark, sf_dir, monkeypatch):
    """Eight buckets whatever the rows: a task's share grew with the panel."""
    from monthmill.plans import prepare

    assert [tables.buckets_for(n) for n in (0, 8_000_000, 8_000_001, 36_000_000, 216_000_000)] == [8, 8, 16, 64, 256]
    monkeypatch.setattr(tables, "BUCKET_ROWS", 500)
    lines = P.table(spark, sf_dir, "lineitem").count()
    assert prepare.sink_bucketed_table(spark, sf_dir).rdd.getNumPartitions() == tables.buckets_for(lines) > 8


def test_scores_of_both_sides_are_made_once(spark, sf_dir):
    """Each of their uses read the panel for the medians again."""
    from monthmill.plans import forecast

    train, test = forecast._sides(P.supplier_panel(spark, sf_dir))
    plan = scoring.train_vs_test(train, test)._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan and "FileScan" not in plan and train.count() == test.count() == 2


def test_picks_by_batches_equal_sql(spark):
    """Picks were made by string functions, 5 microseconds each; block ends, groups and a null group must stay."""
    blocks = spark.createDataFrame([("x", 3, 0, 4095, 5000), ("x", 3, 4096, 4999, 5000), (None, 7, 0, 0, 1)], "scenario string, draw int, from long, to long, users long")
    got = blocks.mapInArrow(paired._picks(["scenario", "draw"], paired.SEED), "scenario string, draw int, no long").collect()
    pick = lambda draw, place, users: int(hashlib.md5(f"{draw}|{place}|{paired.SEED}".encode()).hexdigest()[:8], 16) % users
    assert sorted(map(tuple, got), key=str) == sorted([("x", 3, pick(3, p, 5000)) for p in range(5000)] + [(None, 7, 0)], key=str)


def test_spread_of_lags_makes_no_windows_of_its_own(spark, sf_dir):
    """The spread names the lags many times; each is one window all the same."""
    for panel in (P.supplier_panel, P.customer_panel):
        plan = panel(spark, sf_dir).select(P.ID, P.TIME, *P.LAGS, P.ROLL3[1])._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("windowspecdefinition") == 4  # the running balance and three lags
