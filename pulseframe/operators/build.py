"""From samples and a configuration to judged windows, their accounting, and profiles of amplitudes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.operators import dsp, qc
from pulseframe.operators import windows as win
from pulseframe.sources.signals import KEYS, PreprocessConfig

#: Names of limits in configurations -> here, where they differ.
LIMIT_NAMES = {"clip_min_run": "min_clip_run", "max_powerline_ratio": "max_mains"}
REASONS = ("dropout", "saturation", "clipping", "amplitude_low", "amplitude_high", "baseline_offset", "powerline")


def judged_windows(samples: DataFrame, config: PreprocessConfig, rate: float, channels=win.CHANNELS, preprocessed: bool = False) -> DataFrame:
    """Windows with failures (distinct reasons, over the inspected channels in their order) and valid.

    Samples (keys, sample_idx, label, repetition, channels) at the rate are resampled and filtered as configured, unless preprocessed.
    Windows whose label changes are left out first if the configuration says so: that is a matter of labels, so they
    count neither as kept nor as rejected. A window is valid if no inspected channel (qc_channels; all by default) fails a check;
    interference from the mains is checked if qc_powerline is set. Recordings shorter than a window have none; those
    too short for a filter are undefined (NaN), which no limit rejects.
    """
    if not preprocessed:
        samples = dsp.preprocess(samples, config, rate, channels, short="nan")
    w = win.sliding(samples, config.samples(config.window_ms), config.samples(config.stride_ms), channels)
    if config.pure_windows:
        w = w.filter("pure")
    given = {LIMIT_NAMES.get(k, k): v for k, v in config.qc_kwargs.items()}
    mains = given.pop("mains_hz", 50.0)
    if unknown := set(given) - set(qc.DEFAULTS):
        raise ValueError(f"no such limits: {sorted(unknown)}")
    inspected = qc.places(list(channels), config.qc_channels)
    return qc.judge(w, inspected, qc.limits(**given), config.target_sample_rate if config.qc_powerline else None, mains)


def build_windows(samples: DataFrame, config: PreprocessConfig, rate: float, channels=win.CHANNELS, preprocessed: bool = False) -> DataFrame:
    """The valid windows of judged_windows. Repetitions are all or nothing: null for all, unless every
    sample of the recordings that are long enough for a window has one."""
    kept = judged_windows(samples, config, rate, channels, preprocessed).filter("valid").drop("failures", "valid")
    width = config.samples(config.window_ms) * (1 if preprocessed else rate / config.target_sample_rate)
    known = samples.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("repetition").isNotNull()).alias("known"))
    known = known.filter(F.col("n") >= width).agg(F.bool_and("known").alias("_known"))
    return kept.crossJoin(F.broadcast(known)).withColumn("repetition", F.when(F.col("_known"), F.col("repetition"))).drop("_known")


def account(judged: DataFrame, *by: str) -> DataFrame:
    """total, kept, rejected, rejection_rate and rejected_by_reason (a map of those that occurred) by keys, in one aggregation.
    A window with two reasons is rejected once and counts under both."""
    counts = {r: F.count_if(F.array_contains("failures", r)).alias(r) for r in REASONS}
    out = judged.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if("valid").alias("kept"), *counts.values())
    named = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(r).alias("reason"), F.col(r).alias("n")) for r in REASONS)), lambda e: e["n"] > 0))
    out = out.withColumn("rejected", F.col("total") - F.col("kept")).withColumn("rejection_rate", qc.rate(F.col("rejected"), F.col("total")))
    return out.select(*by, "total", "kept", "rejected", "rejection_rate", named.alias("rejected_by_reason"))


def sampled_starts(samples: DataFrame, width: int, stride: int, most: int) -> DataFrame:
    """(keys, seq, start_idx) of at most so many windows a recording, evenly spaced over all of its starts, from its length alone."""
    sized = samples.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n")).withColumn("_starts", F.expr(f"(_n - {width}) div {stride} + 1")).filter(F.col("_n") >= width)
    last = F.col("_starts") - 1
    spaced = lambda k: F.when(k == most - 1, last).otherwise((k * (last / F.lit(float(max(1, most - 1))))).cast("long"))
    picks = F.when(F.col("_starts") <= most, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long")), spaced))
    return sized.select(*KEYS, F.explode(picks).alias("seq")).withColumn("start_idx", F.col("seq") * stride)


def sampled_profile(samples: DataFrame, width: int, stride: int, channels=win.CHANNELS, most: int = 2000) -> DataFrame:
    """Rows (keys, seq, channel, rms, mean, absmax) of at most so many windows a recording; no other window is built.

    Starts meet samples by pane (the stretches that width and stride divide by), so a sample moves once, and
    goes on only for the windows that hold it. No window may give no rows.
    """
    pane = math.gcd(width, stride)
    starts = sampled_starts(samples, width, stride, most)
    wanted = starts.withColumn("_pane", F.explode(F.sequence(F.expr(f"start_idx div {pane}"), F.expr(f"start_idx div {pane} + {width // pane - 1}"))))
    rows = samples.select(*KEYS, F.expr(f"sample_idx div {pane}").alias("_pane"), *channels).join(wanted, [*KEYS, "_pane"])
    stats = [f for c in channels for f in (F.sqrt(F.avg(F.col(c) * F.col(c))).alias(f"rms_{c}"), F.avg(c).alias(f"mean_{c}"), F.max(F.abs(c)).alias(f"absmax_{c}"))]
    wide = rows.groupBy(*KEYS, "seq").agg(*stats)
    part = lambda c: F.struct(F.lit(c).alias("channel"), *(F.col(f"{n}_{c}").alias(n) for n in ("rms", "mean", "absmax")))
    return wide.select(*KEYS, "seq", F.explode(F.array(*map(part, channels))).alias("c")).select(*KEYS, "seq", "c.*")


def profile_recordings(samples: DataFrame, config: PreprocessConfig, rate: float, channels=win.CHANNELS, most: int = 2000) -> DataFrame:
    """sampled_profile of the recordings as the quality gate sees them: resampled and filtered."""
    prepared = dsp.preprocess(samples, config, rate, channels, short="nan")
    return sampled_profile(prepared, config.samples(config.window_ms), config.samples(config.stride_ms), channels, most)
