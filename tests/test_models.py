"""Discriminants at any scale, regressions against plain Newton, quantiles with infinities, filters against whole recordings."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.operators import dsp, models, qc, quantiles


def labelled(spark, n=300, classes=2, keys=("a", "b"), seed=0):
    rng = np.random.default_rng(seed)
    rows = [(k, int(c), *(float(v) for v in rng.normal(c * (0.5 + i), 1 + i, 2))) for i, k in enumerate(keys) for c in rng.integers(0, classes, n)]
    return spark.createDataFrame(rows, "k string, label int, x double, y double"), rows


def plain_newton(x, y, classes, c=1.0, steps=60):
    """Weights (classes by features, the last the intercept) of penalised softmax regression; of two classes the first has none."""
    x = np.column_stack([x, np.ones(len(x))])
    d, free = x.shape[1], classes - 1 if classes == 2 else classes
    w = np.zeros((free, d))
    penalty = np.diag(np.tile(np.append(np.ones(d - 1), 0.0), free)) / c
    for _ in range(steps):
        full = np.vstack([np.zeros((classes - free, d)), w])
        p = np.exp(x @ full.T - (x @ full.T).max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = ((p - np.eye(classes)[y])[:, classes - free :].T @ x).ravel() + penalty @ w.ravel()
        h = penalty.copy()
        for a in range(free):
            for b in range(free):
                pa, pb = p[:, classes - free + a], p[:, classes - free + b]
                h[a * d : (a + 1) * d, b * d : (b + 1) * d] += (x * (pa * ((a == b) - pb))[:, None]).T @ x
        w = w - np.linalg.lstsq(h, g, rcond=1e-13)[0].reshape(free, d)
    return np.vstack([np.zeros((classes - free, d)), w])


@pytest.mark.parametrize("classes", [2, 3])
def test_regressions_side_by_side_equal_plain_newton(spark, classes):
    df, rows = labelled(spark, 200, classes)
    got = {r.k: r for r in models.logistic_by(df.repartition(3), ["x", "y"], "k").collect()}
    for k in ("a", "b"):
        mine = np.array([r[2:] for r in rows if r[0] == k]), np.array([r[1] for r in rows if r[0] == k])
        want = plain_newton(*mine, classes)
        assert got[k].n_train == 200 and got[k].classes == list(range(classes))
        assert np.allclose(np.column_stack([got[k].weights, got[k].biases]), want, atol=1e-6)


def test_jobs_follow_iterations_and_not_keys(spark):
    def jobs(n):
        df, _ = labelled(spark, 40, 2, [f"k{i}" for i in range(n)])
        group = f"jobs-{n}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            models.logistic_by(df, ["x", "y"], "k").collect()
        finally:
            spark.sparkContext.setJobGroup("", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(12) <= jobs(1) * 1.6 + 4


def test_regression_edges(spark):
    df = spark.createDataFrame([("one", 1, 0.5, 1.0)] * 5 + [("apart", 0, -1.0, 0.0), ("apart", 1, 1.0, 0.0)], "k string, label int, x double, y double")
    fitted = models.logistic_by(df, ["x", "y"], "k")
    out = {(r.k, r.x): (r.y_pred, round(r.confidence, 3)) for r in models.predict_by(df, fitted, ["x", "y"], "k").collect()}
    assert out["one", 0.5] == (1, 1.0) and out["apart", -1.0][0] == 0 and out["apart", 1.0][0] == 1
    with pytest.raises(Exception, match="without a feature"):
        models.logistic_by(spark.createDataFrame([("a", 0, None, 1.0)], df.schema), ["x", "y"], "k")
    assert models.logistic_by(df.limit(0), ["x", "y"], "k").count() == 0


@pytest.mark.parametrize("scale", [1.0, 1e-5, 1e6])
def test_discriminants_do_not_depend_on_units(spark, scale):
    df, _ = labelled(spark)
    small = df.withColumns({"x": F.col("x") * scale, "y": F.col("y") * scale / 1000})
    want = [r.y_pred for r in models.predict_by(df, models.discriminants(df, ["x", "y"], "k"), ["x", "y"], "k").orderBy("k", "x").collect()]
    scored = models.predict_by(small, models.discriminants(small, ["x", "y"], "k"), ["x", "y"], "k").orderBy("k", "x")
    assert [r.y_pred for r in scored.collect()] == want and len(want) == 600
    assert [r.y_pred for r in models.Discriminant.fit(small, ["x", "y"]).predict(small).orderBy("k", "x").collect()] == [r.y_pred for r in models.Discriminant.fit(df, ["x", "y"]).predict(df).orderBy("k", "x").collect()]


def test_repeated_and_constant_columns_take_nothing_away(spark):
    df, _ = labelled(spark)
    more = df.withColumns({"again": F.col("x") * 3, "same": F.lit(7.0)})
    alone = models.predict_by(df, models.discriminants(df, ["x", "y"], "k"), ["x", "y"], "k").orderBy("k", "x", "y")
    columns = ["x", "y", "again", "same"]
    both = models.predict_by(more, models.discriminants(more, columns, "k"), columns, "k").orderBy("k", "x", "y")
    assert [r.y_pred for r in both.collect()] == [r.y_pred for r in alone.collect()]
    assert np.allclose([r.confidence for r in both.collect()], [r.confidence for r in alone.collect()])
    flat = spark.createDataFrame([("k", c % 2, 1.0) for c in range(6)] + [("k", 0, 1.0)], "k string, label int, x double")
    assert {r.y_pred for r in models.predict_by(flat, models.discriminants(flat, ["x"], "k"), ["x"], "k").collect()} == {0}  # the more frequent class


def test_rows_without_a_model_are_an_error(spark):
    df, _ = labelled(spark)
    fitted = models.discriminants(df.filter("k = 'a'"), ["x", "y"], "k")
    assert models.predict_by(df.filter("k = 'a'"), fitted, ["x", "y"], "k").count() == 300
    with pytest.raises(Exception, match="no model for/b"):
        models.predict_by(df, fitted, ["x", "y"], "k").collect()


def test_any_model_over_all_splits(spark):
    df, rows = labelled(spark)

    def nearest_mean(x, y, new):
        means = np.array([x[y == c].mean(axis=0) for c in (0, 1)])
        d = ((new[:, None, :] - means) ** 2).sum(axis=2)
        return d.argmin(axis=1), 1 / (1 + np.exp(d.min(axis=1) - d.max(axis=1)))

    out = models.predict_any(df, df, ["x", "y"], nearest_mean, "k")
    assert out.count() == 600 and out.filter("y_pred = label").count() > 350 and out.filter("confidence < 0.5").count() == 0
    with pytest.raises(Exception, match="no training rows"):
        models.predict_any(df.filter("k = 'a'"), df, ["x", "y"], nearest_mean, "k").count()
    with pytest.raises(Exception, match="predictions for"):
        models.predict_any(df, df, ["x", "y"], lambda x, y, new: (new[:1, 0], new[:1, 0]), "k").count()


@pytest.mark.parametrize("fetched, bins", [(20_000, 1024), (5, 4)])
def test_quantiles_with_infinities_and_huge_spans_end(spark, monkeypatch, fetched, bins):
    monkeypatch.setattr(quantiles, "FETCHED", fetched)
    monkeypatch.setattr(quantiles, "BINS", bins)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, 60), 10.0 ** rng.uniform(-300, 300, 60), -(10.0 ** rng.uniform(-300, 300, 30)), [0.0, 5e-324, 1e-323, 1.7e308, -1.7e308], [math.inf] * 9, [-math.inf] * 7])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(3)
    asked = {f"q{k}": (F.col("x"), q) for k, q in enumerate((0, 0.01, 0.1, 0.3, 0.5, 0.7, 0.9, 0.99, 1))}
    got, s = quantiles.exact_quantiles(df, asked), np.sort(x)
    for name, (_, q) in asked.items():
        low, high = s[math.floor(q * (len(s) - 1))], s[math.ceil(q * (len(s) - 1))]
        assert low <= got[name] <= high


def test_many_values_with_one_infinity(spark):
    df = spark.range(30_000).select(F.when(F.col("id") == 7, float("inf")).otherwise(F.col("id").cast("double")).alias("x"))
    got = quantiles.exact_quantiles(df, {"m": (F.col("x"), 0.5), "most": (F.col("x"), 1.0)})
    assert got == {"m": pytest.approx(15_000.0, abs=1), "most": math.inf}


def test_settings_of_an_empty_profile_are_null(spark):
    empty = spark.createDataFrame([], "rms double, mean double, absmax double")
    assert set(qc.corruption_settings(empty).first()) == {None} and set(qc.thresholds(empty).first()) == {None}
    assert qc.derivation("max_rms", margin=2.5) == "2.5 times the 0.999 quantile of window RMS" and qc.derivation("min_rms", low=0.2).startswith("0.2 times")


def samples(spark, lengths):
    rng = np.random.default_rng(8)
    data = {f"d{k}": rng.normal(0, 1, (n, 2)) for k, n in enumerate(lengths)}
    rows = [("s", d, i, 0, 0, float(a), float(b)) for d, x in data.items() for i, (a, b) in enumerate(x)]
    return spark.createDataFrame(rows, "subject_id string, session_id string, sample_idx long, label int, repetition int, ch0 double, ch1 double").repartition(3), data


def test_filters_in_passes_equal_whole_recordings(spark):
    df, data = samples(spark, (700, 1500))
    got = dsp.filter_recordings(df, 1000.0).orderBy("sample_idx").toPandas()
    for d, x in data.items():
        for k, c in enumerate(("ch0", "ch1")):
            want = x[:, k]
            for b, a in (dsp.butterworth_bandpass(20.0, 450.0, 1000.0), dsp.notch(50.0, 1000.0)):
                want = dsp.zero_phase(b, a, want)
            assert np.allclose(got[got.session_id == d][c], want, atol=1e-9)


def test_resampling_in_passes_equals_whole_recordings(spark):
    df, data = samples(spark, (601, 40))
    got = dsp.resample_recordings(df, 1000.0, 800.0).orderBy("sample_idx").toPandas()
    for d, x in data.items():
        assert np.allclose(got[got.session_id == d]["ch1"], dsp.resample(x[:, 1], 1000, 800), atol=1e-9)


def test_short_recordings_are_undefined_or_an_error(spark):
    df, _ = samples(spark, (700, 12, 1))
    out = dsp.filter_recordings(df, 1000.0, short="nan").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.isnan("ch0") & F.isnan("ch1")).alias("undefined")).orderBy("session_id").collect()
    assert [(r.n, r.undefined) for r in out] == [(700, 0), (12, 12), (1, 1)]
    with pytest.raises(Exception, match="more than"):
        dsp.filter_recordings(df, 1000.0).count()
    with pytest.raises(ValueError):
        dsp.filter_recordings(df, 1000.0, short="drop")
