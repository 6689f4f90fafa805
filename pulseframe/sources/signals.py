"""Where signals come from and go to: event streams, array columns, file indexes, caches, logs."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseframe.sources.storage import Snapshots, exists, read_text

KEYS = ("subject_id", "session_id")
SAMPLES = "source string, subject_id string, session_id string, sample_idx long, label int, repetition int, ch array<double>"


@dataclass(frozen=True)
class PreprocessConfig:
    """The knobs that decide what windows a recording gives."""

    target_sample_rate: float = 1000.0
    bandpass_hz: tuple | None = (20.0, 450.0)
    notch_hz: float | None = 50.0
    window_ms: float = 200.0
    stride_ms: float = 50.0
    pure_windows: bool = True
    qc_kwargs: dict = field(default_factory=dict)
    qc_powerline: bool = False
    qc_channels: tuple | None = None

    def samples(self, ms: float) -> int:
        """Milliseconds as samples, halves to even, one at least."""
        return max(1, round(ms * self.target_sample_rate / 1000))

    def fingerprint(self) -> str:
        """First 16 hex digits of the SHA-256 of the settings as JSON with sorted keys."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


def samples_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as two-channel recordings, one row per sample."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k"), day.alias("day"))
    raw = raw.select(
        F.concat(F.lit("s0"), (F.col("user_id") % 5).cast("string")).alias("subject_id"),
        F.concat(F.lit("d0"), F.floor(F.col("day") / 3).cast("string")).alias("session_id"),
        "ts",
        "event_id",
        (F.col("day") % 3).cast("int").alias("label"),
        F.when(F.col("day") % 3 == 0, 0).otherwise(1 + F.floor(F.hour("ts") / 6)).cast("int").alias("repetition"),
        ((F.col("value") - 50) / 50).alias("ch0"),
        ((F.col("k") - 50) / 50).alias("ch1"),
    )
    return numbered(raw, "ts", "event_id").drop("ts", "event_id")


def numbered(df: DataFrame, time: str, tie: str, tick_s: int = 60) -> DataFrame:
    """Add sample_idx: the place of each row in its recording in order of time, then tie; rows without a time come first.

    Rows are counted by recording and tick; the sums over earlier ticks are offsets, and rows are ranked
    inside their tick. So no task holds a recording, however long: what meets for one is a row a tick.
    """
    tick = F.coalesce(F.floor(F.unix_timestamp(time) / tick_s), F.lit(-(1 << 62)))
    rows = df.withColumn("_tick", tick)
    earlier = Window.partitionBy(*KEYS).orderBy("_tick").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*KEYS, "_tick").agg(F.count(F.lit(1)).alias("_n")).select(*KEYS, "_tick", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_ahead"))
    rank = F.row_number().over(Window.partitionBy(*KEYS, "_tick").orderBy(F.asc_nulls_first(time), tie)) - 1
    return rows.withColumn("_rank", rank).join(offsets, [*KEYS, "_tick"]).withColumn("sample_idx", (F.col("_ahead") + F.col("_rank")).cast("long")).drop("_tick", "_rank", "_ahead")


def embedding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready-made 64-sample windows: vec_id, label, x."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def recording_index(paths: DataFrame, path: str = "path") -> DataFrame:
    """File paths with a subject, a day and a time in their names: sorted keys, others dropped."""
    stem = F.regexp_extract(F.col(path), r"([^/]*)$", 1)
    part = lambda k: F.regexp_extract(stem, r"(?i)S(\d+)_D(\d+)_T(\d+)", k).try_cast("int")
    good = paths.filter(~stem.startswith("._") & ~F.col(path).contains("__MACOSX") & part(1).isNotNull())
    return good.select(path, F.format_string("s%02d", part(1)).alias("subject_id"), F.format_string("d%02d_t%02d", part(2), part(3)).alias("session_id"))


def list_recordings(spark: SparkSession, root: str, glob: str = "*.mat") -> DataFrame:
    """Index of the binary files under root; their contents aren't read. A root without any, or with none whose name tells subject, day and time, is an error."""
    if not exists(spark, root):
        raise FileNotFoundError(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path")
    if files.isEmpty():
        raise FileNotFoundError(f"no {glob} under {root}")
    found = recording_index(files)
    if found.isEmpty():
        raise ValueError(f"no name under {root} tells subject, day and time, such as {[r.path for r in files.limit(5).collect()]}")
    return found


def synthetic_samples(spark: SparkSession, subjects: int = 3, sessions: int = 4, channels: int = 2, rate: float = 1000.0, block_s: float = 1.0, pairs: int = 6, drift: float = 0.25, seed: int = 0) -> DataFrame:
    """Recordings of pairs of rest and activity, drifting from session to session; each is drawn where it is needed. Subjects and sessions count from 1."""

    def draw(keys: pd.DataFrame) -> pd.DataFrame:
        s, k = int(keys["s"].iloc[0]), int(keys["k"].iloc[0])
        rng = np.random.default_rng([seed, s, k])
        n = int(block_s * rate)
        gain = (1 + drift * k) * (1 + 0.1 * s)
        parts, labels, reps = [], [], []
        for b in range(2 * pairs):
            active = b % 2
            parts.append(rng.normal(0, 1, (n, channels)) * (0.06 if active else 0.01) * gain + 0.002 * k)
            labels += [active] * n
            reps += [(b // 2 + 1) if active else 0] * n
        x = np.concatenate(parts)
        return pd.DataFrame({"source": "synthetic", "subject_id": f"s{s + 1:02d}", "session_id": f"d{k + 1:02d}", "sample_idx": np.arange(len(x)), "label": labels, "repetition": reps, "ch": list(x)})

    grid = spark.range(subjects * sessions).select((F.col("id") / sessions).cast("int").alias("s"), (F.col("id") % sessions).cast("int").alias("k"))
    return grid.groupBy("s", "k").applyInPandas(draw, SAMPLES)


def load(samples: DataFrame, subjects: list[str] | None = None, sessions: list[str] | None = None) -> DataFrame:
    """Samples of the subjects and sessions (None: all); both are partition columns of cached recordings, so others aren't read."""
    for column, wanted in zip(KEYS, (subjects, sessions)):
        samples = samples if wanted is None else samples.filter(F.col(column).isin(list(wanted)))
    return samples


def config_of(settings: dict) -> PreprocessConfig:
    """A configuration from its settings, as JSON has them (lists for pairs); a setting that there isn't is an error."""
    return PreprocessConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in settings.items()})


def read_config(spark: SparkSession, path: str) -> dict:
    """Settings from a JSON file, wherever Spark reads; FileNotFoundError where there is none."""
    text = read_text(spark, path)
    if text is None:
        raise FileNotFoundError(path)
    return json.loads(text)


def synthetic_frames(spark: SparkSession, n: int = 200, size: int = 50, rate: float = 1000.0, lost: tuple[int, int] = (75, 85), seed: int = 0) -> DataFrame:
    """One run of frames (run_id, i, x, valid, latency): bursts under a square envelope with noise; the lost frames are flat and not valid."""
    t = np.arange(n * size) / rate
    raw = 0.6 * (np.sin(np.pi * t) > 0) + 0.05 * np.random.default_rng(seed).standard_normal(n * size)
    raw = raw.reshape(n, size)
    raw[slice(*lost)] = 0.0
    rows = [("synthetic", i, x.tolist(), not lost[0] <= i < lost[1], 0.0) for i, x in enumerate(raw)]
    return spark.createDataFrame(rows, "run_id string, i long, x array<double>, valid boolean, latency double")


def select_channels(df: DataFrame, indices: list[int], n_channels: int, column: str = "ch") -> DataFrame:
    """Keep the channels in the order given; an index out of range is an error."""
    if bad := [i for i in indices if not 0 <= i < n_channels]:
        raise IndexError(f"no such channels: {bad}")
    return df.withColumn(column, F.array(*(F.col(column)[i] for i in indices)))


def frames(df: DataFrame, column: str = "x", rate: float = 1000.0, id_column: str = "vec_id") -> DataFrame:
    """One row per sample of an array column, with its time in seconds."""
    return df.select(id_column, F.posexplode(column).alias("pos", "value")).withColumn("timestamp", F.col("pos") / F.lit(rate))


def save_windows(df: DataFrame, path: str, config: PreprocessConfig, **manifest) -> None:
    """Windows as Parquet by subject and session under the configuration's fingerprint; the manifest that names them is put last, in one step."""
    Snapshots(df.sparkSession, path).write(df, config.fingerprint(), {**manifest, "config": asdict(config), "fingerprint": config.fingerprint()}, KEYS)


def load_windows(spark: SparkSession, path: str, config: PreprocessConfig) -> tuple[DataFrame, dict]:
    """The windows that were saved under a configuration, and their manifest; FileNotFoundError without any."""
    snapshots = Snapshots(spark, path)
    return snapshots.read(config.fingerprint()), snapshots.manifest(config.fingerprint())


def windows_or_build(spark: SparkSession, path: str, config: PreprocessConfig, build) -> DataFrame:
    """The cached windows of the configuration, else built and cached."""
    if Snapshots(spark, path).manifest(config.fingerprint()) is None:
        save_windows(build(), path, config)
    return load_windows(spark, path, config)[0]


def write_csv(df: DataFrame, path: str, sort_columns: bool = True) -> None:
    """A folder of CSV parts, each with a header; columns sorted by name, or in their order."""
    df.select(*(sorted(df.columns) if sort_columns else df.columns)).write.mode("overwrite").csv(path, header=True)


def write_events(df: DataFrame, path: str) -> None:
    """Append log events (timestamp, kind, data) as JSON lines."""
    df.select("timestamp", "kind", "data").write.mode("append").json(path)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
