"""Queries against their oracles on a small input, and the rules that SQL can't check."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.functions import arrays
from pulseframe.operators import decision, dsp, metrics, models, qc, splits, windows
from pulseframe.plans import catalog
from pulseframe.sources import signals
from pulseframe.streaming import loop

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if v is None or v != v else v.item() if hasattr(v, "item") else v
    return sorted(repr(tuple(map(plain, r))) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in catalog.ORACLES if not n.startswith(("feat_rms", "feat_mav", "feat_zcr", "feat_wl", "feat_ssc", "qc_dropout", "qc_clip", "qc_sat"))])
def test_oracle(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(catalog.ORACLES[name]).fetchdf())


def test_queries_without_oracles_run(spark):
    for name in set(catalog.QUERIES) - set(catalog.ORACLES):
        assert catalog.QUERIES[name](spark, SF).count() > 0


def test_undefined_values_pass_the_checks(spark):
    df = spark.createDataFrame([([float("nan")] * 20, float("nan"), float("nan"), float("nan"))], "x array<double>, std double, mean double, rms double")
    got = df.select(*(c.alias(k) for k, c in qc.reasons(qc.limits()).items())).first()
    assert not any(got)


def test_zero_counts_as_positive_and_windows_do_not_cross(spark):
    data = [("s", f"d{k}", i, 0, 0, float(v), 0.0) for k in range(2) for i, v in enumerate([0, 1, -1, 0, 1, 1, 1, 1])]
    df = spark.createDataFrame(data, "subject_id string, session_id string, sample_idx long, label int, repetition int, ch0 double, ch1 double")
    got = windows.sliding(df, width=4, stride=2).orderBy("session_id", "seq").collect()
    assert len(got) == 6 and [round(r.zcr_ch0 * 3) for r in got[:3]] == [2, 1, 0] and [r.start_idx for r in got[:3]] == [0, 2, 4]
    assert windows.sliding(df.filter("sample_idx < 3"), width=4).count() == 0


def test_window_sizes_round_half_to_even():
    c = signals.PreprocessConfig(target_sample_rate=1000)
    assert c.samples(62.5) == 62 and c.samples(0.1) == 1 and windows.guard_windows(200, 50) == 3 and windows.guard_windows(None, 1) == 0
    assert len(c.fingerprint()) == 16 and c.fingerprint() != signals.PreprocessConfig(notch_hz=None).fingerprint()


def test_calibration_bins_are_closed_above(spark):
    df = spark.createDataFrame([(0, 1, 0.95)] * 4, "y_true int, y_pred int, confidence double")
    assert abs(metrics.expected_calibration_error(df).first().ece - 0.95) < 1e-12
    assert df.select(metrics.bin_of(F.lit(-1.0)), metrics.bin_of(F.lit(0.1)), metrics.bin_of(F.lit(0.30000000000000004)), metrics.bin_of(F.lit(1.0))).first()[:] == (0, 0, 2, 9)
    assert metrics.reliability(df).count() == 10 and metrics.safety(df).first().unsafe_assist_rate == 1.0 and math.isnan(metrics.safety(df).first().assist_availability)


def test_no_window_is_on_both_sides(spark):
    w = catalog.pure(spark, SF)
    for assigned in (splits.within_time(w), splits.within_repetition(w), splits.cross_session(w), splits.cross_subject(w), splits.random_shuffle(w), splits.calibrate_class(splits.cross_session(w))):
        assert splits.overlaps(assigned).count() == 0


def test_states_equal_a_fold_and_the_stream(spark, tmp_path):
    ticks = catalog.ticks(spark, SF).withColumn("run_id", F.concat("subject_id", "session_id"))
    flat = decision.faults(ticks, "run_id").withColumn("safety_ok", F.col("safety_ok") & F.col("fault").isNull())
    want = {(r.run_id, r.i): (r.missed, r.state) for r in decision.states(flat, "run_id").collect()}
    ticks.drop("subject_id", "session_id").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = loop.run_loop(spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("loop_states").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.run_id, r.i): (r.missed, r.state) for r in spark.table("loop_states").collect()} == want


def test_filters():
    rate, n = 1000.0, 4000
    t = np.arange(n) / rate
    b, a = dsp.butterworth_bandpass(20, 450, rate)
    for f, gain in ((100, 1.0), (2, 0.0)):
        x = np.sin(2 * np.pi * f * t)
        y = dsp.zero_phase(b, a, x)
        assert abs(np.sqrt(np.mean(y[500:-500] ** 2) * 2) - gain) < 0.02
        if gain:
            assert np.abs(y[500:-500] - x[500:-500]).max() < 0.02
    b, a = dsp.notch(50, rate)
    hum = np.sin(2 * np.pi * 50 * t)
    assert np.abs(dsp.zero_phase(b, a, hum)[1500:-1500]).max() < 0.02 and dsp.mains_share(hum, rate) > 0.9 and dsp.mains_share(hum[:10], rate) == 0.0
    slow = np.sin(2 * np.pi * 5 * t)
    half = dsp.resample(slow, 1000, 500)
    assert len(half) == 2000 and np.abs(half[100:-100] - slow[::2][100:-100]).max() < 0.01
    with pytest.raises(ValueError):
        dsp.butterworth_bandpass(20, 600, rate)


def test_recordings_are_filtered_one_by_one(spark):
    df = signals.synthetic_samples(spark, subjects=1, sessions=2, rate=500.0).select("subject_id", "session_id", "sample_idx", "label", "repetition", F.col("ch")[0].alias("ch0"), F.col("ch")[1].alias("ch1"))
    assert dsp.filter_recordings(df, 500.0, band=(20.0, 200.0)).count() == df.count() == 12000


def test_models(spark):
    rng = np.random.default_rng(0)
    data = [(int(k), float(x), float(y)) for k in range(3) for x, y in rng.normal(k * 2, 1, (100, 2))]
    df = spark.createDataFrame(data, "label int, a double, b double")
    got = models.Discriminant.fit(df, ["a", "b"]).predict(df).toPandas()
    assert (got.label == got.y_pred).mean() > 0.8 and got.confidence.between(1 / 3, 1).all()
    assert (models.logistic(df, ["a", "b"])(df).toPandas().eval("label == y_pred")).mean() > 0.8
    one = models.OneClass.fit(df, ["a", "b"], contamination=0.1)
    assert abs(df.select(F.avg(one.flag().cast("double"))).first()[0] - 0.1) < 0.02
    with pytest.raises(ValueError):
        models.OneClass.fit(df, ["a"], contamination=0)


def test_faults_are_found(spark):
    rate = {r.mode: r.detected for r in catalog.detection(spark, SF).collect()}
    assert rate["dropout"] == rate["clipping"] == rate["saturation"] == 1.0 and set(rate) == set(arrays.MODES)
    with pytest.raises(ValueError):
        arrays.inject(F.col("x"), "unknown", 64)


def test_cache_round_trip(spark, tmp_path):
    config, path = signals.PreprocessConfig(), str(tmp_path / "cache")
    build = lambda: catalog.pure(spark, SF)
    first = signals.windows_or_build(spark, path, config, build)
    again = signals.windows_or_build(spark, path, config, lambda: pytest.fail("built twice"))
    assert first.count() == again.count() == build().count()
    signals.write_csv(build(), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == sorted(build().columns)
    signals.write_events(spark.createDataFrame([(0.5, "state", {"to": "IDLE"})], "timestamp double, kind string, data map<string,string>"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).first().kind == "state"


@pytest.mark.parametrize("name", ["qc_report", "qc_window_failures", "agg_calibrate"])
def test_quality_computes_its_windows_once(spark, monkeypatch, name):
    made, windows_of = [], catalog.windows
    monkeypatch.setattr(catalog, "windows", lambda *a: made.append(a) or windows_of(*a))
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(made) == 1
    assert "hashpartitioning" not in plan and "events.parquet" not in plan  # nothing is windowed again, and no window moves to be judged
