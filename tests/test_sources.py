"""Matrix files, snapshots, batches that count once, and the threshold stream."""

import math
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.operators import models
from pulseframe.sources import mat, signals, storage
from pulseframe.streaming import threshold

RNG = np.random.default_rng(0)


def variables(n=50, width=16, reps=True):
    out = {"emg": RNG.normal(0, 1, (n, width)), "restimulus": (np.arange(n) % 5).reshape(-1, 1)}
    return out | {"rerepetition": (np.arange(n) // 10).reshape(-1, 1)} if reps else out


def put(folder, name, content):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content)


@pytest.mark.parametrize("compress", [True, False])
def test_matrices_are_read_back(compress):
    want = variables()
    got = mat.read_variables(mat.file_of(want, compress))
    assert got.keys() == want.keys() and all(np.array_equal(got[k], want[k]) for k in want)
    assert mat.read_variables(mat.file_of(want, compress), {"emg"})["restimulus"] is None


def test_big_endian_small_elements_and_narrow_types():
    def element(kind, data):
        if len(data) <= 4:
            return struct.pack(">HH", len(data), kind) + data.ljust(4, b"\0")
        return struct.pack(">II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    body = element(6, struct.pack(">II", 9, 0)) + element(5, struct.pack(">ii", 3, 1)) + element(1, b"x") + element(3, np.array([1, -2, 300], ">i2").tobytes())
    text = element(6, struct.pack(">II", 4, 0)) + element(5, struct.pack(">ii", 1, 2)) + element(1, b"note") + element(4, b"\0h\0i")
    content = b"h".ljust(124) + struct.pack(">H", 0x0100) + b"MI" + element(14, body) + element(14, text)
    got = mat.read_variables(content)
    assert got["x"].tolist() == [[1], [-2], [300]] and got["note"] is None


@pytest.mark.parametrize("damage", [lambda c: c[:-9], lambda c: c[:100], lambda c: b"x" * 200, lambda c: c[:140] + b"\xff" * 40 + c[180:]])
def test_damage_is_an_error(damage):
    with pytest.raises((ValueError, struct.error, KeyError, StopIteration, mat.zlib.error)):
        mat.recording(damage(mat.file_of(variables())), "restimulus", None)


def test_only_wanted_files_are_opened(spark, tmp_path):
    one, two = variables(), variables(reps=False)
    put(tmp_path, "a/S1_D1_T2.mat", mat.file_of(one))
    put(tmp_path, "b/S2_D1_T1.mat", mat.file_of(two))
    put(tmp_path, "b/S3_D2_T1.mat", b"damaged")
    put(tmp_path, "__MACOSX/._S1_D1_T2.mat", b"")
    got = mat.read_recordings(spark, str(tmp_path), subjects=["s01", "s02"]).orderBy("subject_id", "sample_idx").collect()  # the damaged file would be an error
    assert len(got) == 100 and got[0].session_id == "d01_t02" and got[0].source == "ninapro_db6"
    assert np.array_equal(np.array([r.ch for r in got[:50]]), one["emg"][:, list(mat.CHANNELS)])
    assert [r.label for r in got[:50]] == one["restimulus"].ravel().tolist() and [r.repetition for r in got[:50]] == one["rerepetition"].ravel().tolist()
    assert {r.repetition for r in got[50:]} == {None}
    with pytest.raises(Exception, match="S3_D2_T1"):
        mat.read_recordings(spark, str(tmp_path)).count()
    bad = mat.read_recordings(spark, str(tmp_path), errors="column").filter("error is not null").collect()
    assert len(bad) == 1 and "S3_D2_T1" in bad[0].error and bad[0].ch is None
    assert mat.read_recordings(spark, str(tmp_path), sessions=["none"]).count() == 0
    with pytest.raises(Exception, match="no channel 16"):
        mat.read_recordings(spark, str(tmp_path), subjects=["s01"], channels=(16,)).count()
    with pytest.raises(Exception, match="stimulus"):
        mat.read_recordings(spark, str(tmp_path), subjects=["s01"], label_field="stimulus").count()


def test_nothing_found_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        signals.list_recordings(spark, str(tmp_path / "none"))
    put(tmp_path, "x/readme.txt", b"")
    with pytest.raises(FileNotFoundError):
        signals.list_recordings(spark, str(tmp_path / "x"))
    put(tmp_path, "y/unnamed.mat", b"x")
    with pytest.raises(ValueError, match="unnamed"):
        signals.list_recordings(spark, str(tmp_path / "y"))
    put(tmp_path, "z/s2_d10_t1.mat", b"x")
    assert signals.list_recordings(spark, str(tmp_path / "z")).select("subject_id", "session_id").first()[:] == ("s02", "d10_t01")


def test_the_fingerprint_is_the_published_one():
    config = signals.PreprocessConfig(qc_kwargs=PUBLISHED)
    assert config.fingerprint() == "fed1e81a523e5d6e"


#: The limits under which the published windows were built.
PUBLISHED = {"min_rms": 1.4233084826660847e-07, "flatline_std": 1.4233084826660847e-07, "max_rms": 0.00029521482339798247, "max_offset": 5.735175351859339e-06, "saturation_limit": 0.0013077530844507559}


def test_synthetic_recordings_have_pairs_of_rest_and_activity(spark):
    df = signals.synthetic_samples(spark, subjects=2, sessions=1, rate=100.0)
    r = df.groupBy("subject_id", "session_id").agg(F.count(F.lit(1)).alias("n"), F.max("repetition").alias("reps"), F.avg("label").alias("active")).orderBy("subject_id").collect()
    assert [(x.subject_id, x.session_id, x.n, x.reps, x.active) for x in r] == [("s01", "d01", 1200, 6, 0.5), ("s02", "d01", 1200, 6, 0.5)]


def test_settings_are_read_wherever_spark_reads(spark, tmp_path):
    put(tmp_path, "limits.json", b'{"min_rms":\n 1e-3}')
    assert signals.read_config(spark, str(tmp_path / "limits.json")) == {"min_rms": 1e-3}
    with pytest.raises(FileNotFoundError):
        signals.read_config(spark, str(tmp_path / "none.json"))


def test_a_writer_that_dies_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    config, path = signals.PreprocessConfig(), str(tmp_path / "cache")
    old = spark.createDataFrame([("s", "d", 1)], "subject_id string, session_id string, seq int")
    signals.save_windows(old, path, config, n_windows=1)
    before = signals.load_windows(spark, path, config)[0]
    monkeypatch.setattr(storage, "commit_text", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        signals.save_windows(old.withColumn("seq", F.lit(2)), path, config)
    monkeypatch.undo()
    again, manifest = signals.load_windows(spark, path, config)
    assert [r.seq for r in again.collect()] == [1] and manifest["n_windows"] == 1 and manifest["fingerprint"] == config.fingerprint()
    other = signals.PreprocessConfig(notch_hz=None)
    with pytest.raises(FileNotFoundError):
        signals.load_windows(spark, path, other)
    signals.save_windows(old.withColumn("seq", F.lit(3)), path, config)
    assert [r.seq for r in signals.load_windows(spark, path, config)[0].collect()] == [3]
    assert [r.seq for r in before.collect()] == [1]  # who began with the former version can finish


def test_a_repeated_batch_counts_once(spark, tmp_path, monkeypatch):
    for kind in ("parquet", "json"):
        sink = storage.EpochSink(spark, str(tmp_path / kind), kind)
        batch = spark.createDataFrame([(1,), (2,)], "v int")
        assert sink.read(batch.schema).count() == 0
        sink(batch, 0)
        sink(batch, 0)
        monkeypatch.setattr(storage, "commit_text", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            sink(spark.createDataFrame([(3,)], "v int"), 1)
        monkeypatch.undo()
        assert sorted(r.v for r in sink.read(batch.schema).collect()) == [1, 2]
        sink(spark.createDataFrame([(3,)], "v int"), 1)
        assert sorted(r.v for r in sink.read(batch.schema).collect()) == [1, 2, 3] and sink.epochs() == [0, 1]


def test_trailing_ranks_equal_sorting():
    rng, t, kept = random.Random(2), threshold.Trailing(700), []
    t.BLOCK = 16
    for _ in range(3000):
        v = rng.choice([rng.random(), float(rng.randrange(5)), math.inf, -math.inf])
        t.add(v)
        kept = (kept + [v])[-700:]
        if rng.random() < 0.05:
            assert [t.ranked(k) for k in range(0, len(kept), 37)] == sorted(kept)[::37] and len(t) == len(kept)
            finite = [v for v in kept if math.isfinite(v)]
            assert threshold.Trailing(700, finite).quantile(0.975) == pytest.approx(np.quantile(finite, 0.975))


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    rng = random.Random(5)
    rows = [(s, i, rng.choice([None, math.nan, *[rng.random()] * 8])) for s in ("a", "b") for i in range(120)]
    schema = "session string, seq long, d double"
    df = spark.createDataFrame(rows, schema)
    want = {(r.session, r.seq): r.threshold for r in models.adaptive_threshold(df, "d", "session", most=50, least=10).collect()}
    plain = {}
    for s in ("a", "b"):
        seen = []
        for _, i, d in (r for r in rows if r[0] == s):
            if d is not None and d == d:
                seen = (seen + [d])[-50:]
            plain[s, i] = np.quantile(seen, 0.975) if len(seen) >= 10 else math.inf
    assert want == pytest.approx(plain)
    sink = storage.EpochSink(spark, str(tmp_path / "out"))
    for low, high in ((0, 7), (7, 60), (60, 120)):
        df.filter((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = threshold.adaptive_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "d", "session", most=50, least=10)
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = sink.read(stream.schema).collect()
    assert len(got) == 240 and {(r.session, r.seq): r.threshold for r in got} == pytest.approx(plain)
    assert all(r.flag == (r.d is not None and r.d > plain[r.session, r.seq]) for r in got)


def test_a_reset_begins_anew(spark, tmp_path):
    df = spark.createDataFrame([("a", i, float(i), i == 15) for i in range(30)], "session string, seq long, d double, reset boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = threshold.adaptive_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "d", "session", least=10, reset="reset", fallback=9.0)
    sink = storage.EpochSink(spark, str(tmp_path / "out"))
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {r.seq: r.threshold for r in sink.read(stream.schema).collect()}
    assert got[14] == pytest.approx(np.quantile(range(15), 0.975)) and got[23] == 9.0 and got[29] == pytest.approx(np.quantile(range(15, 30), 0.975))
    with pytest.raises(ValueError):
        threshold.adaptive_stream(df, "d", "session", least=0)


def test_loaders_share_one_interface(spark, tmp_path):
    from pulseframe.sources import loaders

    put(tmp_path, "S1_D1_T1.mat", mat.file_of(variables(30)))
    put(tmp_path, "S2_D1_T1.mat", mat.file_of(variables(20)))
    files = loaders.loader("ninapro_db6", spark, str(tmp_path), channels=(0, 10))
    assert files.subjects() == ["s01", "s02"] and files.load(["s02"]).count() == 20
    files.load().write.partitionBy("subject_id", "session_id").parquet(str(tmp_path / "samples"))
    again = loaders.loader("parquet", spark, str(tmp_path / "samples"))
    assert again.subjects() == files.subjects() and again.load(sessions=["d01_t01"]).count() == 50
    assert set(again.load().columns) == set(files.load().columns) == {"subject_id", "session_id", "sample_idx", "label", "repetition", "ch0", "ch1"}
    with pytest.raises(KeyError, match="parquet"):
        loaders.loader("none", spark, "")

    class Empty(loaders.Loader):
        name = "empty"

        def index(self):
            return self.spark.createDataFrame([], "subject_id string, session_id string")

        def load(self, subjects=None, sessions=None):
            return self.index()

    assert loaders.loader("empty", spark, "").subjects() == []


def test_a_gate_of_ones_own(spark):
    from pulseframe.operators import metrics

    df = spark.createDataFrame([(0, 1, 0.95), (1, 1, 0.45), (1, 1, 0.99)], "y_true int, y_pred int, confidence double")
    never = metrics.safety(df, gate=lambda c: F.lit(0.0)).first()
    hard = metrics.evaluate(df, gate=lambda c: (c >= 0.97).cast("double")).first()
    assert never[:] == (0.0, 0.0) and hard.unsafe_assist_rate == 0.0 and hard.assist_availability == 0.5
