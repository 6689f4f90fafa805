"""Window building: panes and blocks against plain loops, accounting, sampled profiles, the command."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe import __main__ as command
from pulseframe.operators import build, qc, splits, windows
from pulseframe.sources import signals

SAMPLE = "subject_id string, session_id string, sample_idx long, label int, repetition int, ch0 double, ch1 double"


def recording(spark, n, seed=0, subject="s", session="d"):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 2)).round(2)
    return spark.createDataFrame([(subject, session, i, int(i // 37 % 3), int(i // 20), float(a), float(b)) for i, (a, b) in enumerate(x)], SAMPLE), x


def plain(x, width, stride, threshold=0.0):
    out = []
    for start in range(0, len(x) - width + 1, stride):
        w = x[start : start + width]
        d = np.diff(w)
        s = np.where(w < 0, -1, 1)
        zc = np.sum((s[1:] != s[:-1]) & (np.abs(d) > threshold)) / (width - 1)
        ssc = np.sum((d[:-1] * d[1:] < 0) & (np.maximum(np.abs(d[:-1]), np.abs(d[1:])) > threshold)) / (width - 2)
        out.append((start, *w, np.sqrt(np.mean(w**2)), np.mean(np.abs(w)), zc, np.abs(d).sum(), ssc, w.std(), w.mean(), np.abs(w).max()))
    return np.array(out)


@pytest.mark.parametrize("width, stride, block", [(8, 2, 16), (9, 2, 10), (12, 12, 4), (5, 8, 20), (20, 5, 4096)])
def test_panes_in_blocks_equal_plain_windows(spark, width, stride, block):
    df, x = recording(spark, 203)
    got = windows.sliding(df.repartition(5), width, stride, block=block, zc_threshold=0.3).orderBy("seq").toPandas()
    for k, c in enumerate(("ch0", "ch1")):
        want = plain(x[:, k], width, stride, 0.3)
        mine = np.column_stack([got["start_idx"], np.stack(got[f"x_{c}"]), *(got[f"{f}_{c}"] for f in ("rms", "mav", "zcr", "wl", "ssc", "std", "mean", "absmax"))])
        assert np.allclose(mine, want, atol=1e-12)
    labels = np.arange(203) // 37 % 3
    assert got.label.tolist() == [labels[s + width - 1] for s in got.start_idx]
    assert got.pure.tolist() == [len(set(labels[s : s + width])) == 1 for s in got.start_idx]
    assert got.seq.tolist() == list(range(len(got)))


def test_no_task_holds_a_long_recording(spark):
    """One recording has 95 % of the rows: its blocks are dealt out like those of any other."""
    long, _ = recording(spark, 1900, 1)
    short, _ = recording(spark, 100, 2, session="e")
    df = long.unionByName(short)
    panes = windows.sliding(df, 8, 2, block=64).drop("x_ch0", "x_ch1")
    assert panes.count() == (1900 - 8) // 2 + 1 + (100 - 8) // 2 + 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [panes.repartition(1).count()] and panes.groupBy(F.spark_partition_id()).count().toPandas()["count"]
        assert len(sizes) == 4 and sizes.max() < 0.6 * sizes.sum()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plan = panes._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # by recording and block; lags, panes and windows share it


def test_numbers_follow_time_over_ticks(spark):
    rng = np.random.default_rng(3)
    rows = [("s", "d", 1_700_000_000 + int(t), k) for k, t in enumerate(rng.integers(0, 900, 300))] + [("s", "e", None, 1), ("s", "e", 5, 0)]
    df = spark.createDataFrame(rows, "subject_id string, session_id string, t long, k int").withColumn("ts", F.timestamp_seconds("t"))
    got = {(r.session_id, r.sample_idx): (r.t, r.k) for r in signals.numbered(df, "ts", "k", tick_s=60).collect()}
    for session in "de":
        want = sorted((t is not None, t or 0, k) for _, s, t, k in rows if s == session)
        assert [got[session, i][1] for i in range(len(want))] == [k for *_, k in want]


def test_windows_are_judged_and_counted(spark):
    df, x = recording(spark, 400, 4)
    df = df.withColumn("ch1", F.when(F.col("sample_idx").between(100, 160), 0.0).otherwise(F.col("ch1")))
    config = signals.PreprocessConfig(bandpass_hz=None, notch_hz=None, window_ms=20, stride_ms=5, pure_windows=False, qc_kwargs={"max_rms": 1.2, "saturation_limit": 9.0, "max_offset": 9.0})
    judged = build.judged_windows(df, config, 1000.0)
    flat = {r.seq: r.failures for r in judged.collect()}
    for seq, failures in flat.items():
        s = seq * 5
        ch1 = np.where((np.arange(400) >= 100) & (np.arange(400) <= 160), 0.0, x[:, 1])[s : s + 20]
        want = []
        for w in (x[s : s + 20, 0], ch1):
            zeros = max((len(z) for z in "".join("z" if abs(v) < max(1e-6, 0.01 * w.std()) else " " for v in w).split()), default=0)
            rms = np.sqrt(np.mean(w**2))
            want += [k for k, failed in (("dropout", w.std() < 1e-6 or zeros >= 10), ("amplitude_low", rms < 1e-3), ("amplitude_high", rms > 1.2)) if failed]
        assert failures == list(dict.fromkeys(want))
    r = build.account(judged).first()
    assert (r.total, r.kept) == (len(flat), sum(not f for f in flat.values())) and r.rejected_by_reason["dropout"] == sum("dropout" in f for f in flat.values())
    assert build.build_windows(df, config, 1000.0).count() == r.kept
    only = signals.PreprocessConfig(**{**config.__dict__, "qc_channels": (0,)})
    assert all("dropout" not in f.failures for f in build.judged_windows(df, only, 1000.0).collect())
    for bad in ({"qc_channels": (2,)}, {"qc_kwargs": {"no_such": 1}}):
        with pytest.raises((IndexError, ValueError)):
            build.judged_windows(df, signals.PreprocessConfig(**{**config.__dict__, **bad}), 1000.0)


def test_the_mains_are_checked_where_configured(spark):
    hum = [("s", "d", i, 0, None, math.sin(2 * math.pi * 50 * i / 1000), 0.1 * (-1.0) ** i) for i in range(400)]
    df = spark.createDataFrame(hum, SAMPLE)
    config = signals.PreprocessConfig(bandpass_hz=None, notch_hz=None, qc_powerline=True, qc_kwargs={"max_offset": 9.0, "saturation_limit": 9.0})
    judged = build.judged_windows(df, config, 1000.0)
    assert {tuple(r.failures) for r in judged.collect()} == {("powerline",)}
    quiet = signals.PreprocessConfig(**{**config.__dict__, "qc_powerline": False})
    kept = build.build_windows(df, quiet, 1000.0)
    assert kept.count() == 5 and kept.filter("repetition is not null").count() == 0


def test_filters_come_before_windows(spark):
    df, _ = recording(spark, 900, 5)
    short, _ = recording(spark, 20, 6, session="short")
    config = signals.PreprocessConfig(target_sample_rate=500.0, bandpass_hz=(20.0, 200.0), window_ms=100, stride_ms=50, pure_windows=False, qc_kwargs={"saturation_limit": 99.0, "max_offset": 99.0})
    got = build.judged_windows(df.unionByName(short), config, 1000.0)
    assert got.count() == (450 - 50) // 25 + 1 and got.select("session_id").distinct().count() == 1
    with pytest.raises(Exception, match="more than"):
        from pulseframe.operators import dsp

        dsp.preprocess(short, config, 1000.0).count()


@pytest.mark.parametrize("n", [3, 8, 50, 203])
def test_only_sampled_windows_are_profiled(spark, n):
    df, x = recording(spark, n)
    starts = np.arange(0, max(0, n - 8 + 1), 2)
    if starts.size > 7:
        starts = starts[np.linspace(0, starts.size - 1, 7).astype(int)]
    got = build.sampled_profile(df, 8, 2, most=7).orderBy("channel", "seq").collect()
    assert [r.seq * 2 for r in got] == [*starts, *starts]
    for r in got:
        w = x[r.seq * 2 : r.seq * 2 + 8, int(r.channel[-1])]
        assert np.allclose([r.rms, r["mean"], r.absmax], [np.sqrt(np.mean(w**2)), w.mean(), np.abs(w).max()])


def test_the_command_profiles_what_the_gate_sees(spark, tmp_path, capsys):
    df, _ = recording(spark, 3000, 7)
    df.write.parquet(str(tmp_path / "samples"))
    assert command.main(["calibrate", str(tmp_path / "samples"), "--rate", "1000", "--windows", "10"]) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["profile"]["n"] == 20 and out["thresholds"]["max_rms"] > 0 and out["subjects"] == "all"
    want = build.profile_recordings(df, signals.PreprocessConfig(), 1000.0, most=10)
    assert out["thresholds"]["max_rms"] == pytest.approx(qc.thresholds(want).first().max_rms)
    assert command.main(["calibrate", str(tmp_path / "samples"), "--subjects", "none"]) == 1
    (tmp_path / "settings.json").write_text('{"bandpass_hz": [20, 200], "target_sample_rate": 500, "window_ms": 100}')
    capsys.readouterr()
    assert command.main(["calibrate", str(tmp_path / "samples"), "--rate", "1000", "--settings", str(tmp_path / "settings.json")]) == 0
    assert json.loads(capsys.readouterr().out)["profile"]["n"] == 2 * ((1500 - 50) // 25 + 1)
    with pytest.raises(TypeError):
        signals.config_of({"no_such": 1})


def test_channels_keep_their_order_beyond_ten():
    names = [f"ch{k}" for k in range(12)]
    assert qc.places(names, [10, 2]) == ["ch10", "ch2"]


def test_failures_are_listed_in_channel_order(spark):
    rows = [("s", "d", 0, 0, 2, "ch2", ["b"]), ("s", "d", 0, 0, 10, "ch10", ["a"])]
    df = spark.createDataFrame(rows, "subject_id string, session_id string, seq long, label int, position int, channel string, failures array<string>")
    assert qc.window_failures(df).first().failures == ["b", "a"]


@pytest.mark.parametrize("fetched", [10_000, 3])
def test_random_split_has_its_exact_size(spark, monkeypatch, fetched):
    monkeypatch.setattr(splits, "FETCHED", fetched)
    df = spark.range(1001).select(F.lit("s").alias("subject_id"), F.lit("d").alias("session_id"), F.col("id").alias("seq"), F.lit(0).alias("label"), F.lit(0).alias("repetition"))
    one = {(r.seq, r.role) for r in splits.random_shuffle(df.repartition(3)).collect()}
    assert sum(role == "train" for _, role in one) == int(1001 * 0.7)
    assert one == {(r.seq, r.role) for r in splits.random_shuffle(df.repartition(7)).collect()}
    assert splits.random_shuffle(df.limit(1)).first().role == "test" and splits.random_shuffle(df.limit(0)).count() == 0
    assert splits.random_shuffle(df, seed=1).filter("role = 'train'").exceptAll(splits.random_shuffle(df).filter("role = 'train'")).count() > 0
