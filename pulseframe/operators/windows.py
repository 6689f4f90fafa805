"""Sliding windows over recordings, and their statistics as trailing row frames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.sources.signals import KEYS

WIDTH, STRIDE, CHANNELS = 8, 2, ("ch0", "ch1")
FEATURES = ("rms", "mav", "zcr", "wl", "ssc")
#: Samples of a recording that a task takes at once.
BLOCK = 4096


def guard_windows(width: float | None, stride: float | None) -> int:
    """Windows beside a cut that share samples with the other side."""
    return max(0, math.ceil(width / stride) - 1) if width and stride else 0


def sliding(df: DataFrame, width: int = WIDTH, stride: int = STRIDE, channels=CHANNELS, zc_threshold: float = 0.0, block: int = BLOCK) -> DataFrame:
    """One row per window: keys, seq, start_idx, label and repetition of the last sample,
    pure, and per channel the window x_<ch> with its statistics.

    Windows begin at 0, stride, ... and never cross recordings; a recording shorter
    than a window has none. Samples are numbered from 0 without gaps.

    Samples are aggregated to panes as long as width and stride divide by, and windows are
    sums over their panes: what lies inside a pane, and what crosses from one pane to the next. A recording is cut in
    blocks of about that many samples, and the panes that a block's first windows need of the one before are copied to it.
    So one exchange by recording and block serves all, and no task holds a recording. Lists are made once a pane, not once a sample.
    """
    pane = math.gcd(width, stride)
    k, hop = width // pane, stride // pane
    per_block = max(k, -(-block // pane))
    at, own = F.expr(f"sample_idx div {pane}"), F.expr(f"sample_idx div {pane * per_block}")
    needed = F.when(at % per_block >= per_block - (k - 1), F.array(own, own + 1)).otherwise(F.array(own))
    rows = df.select(*KEYS, F.col("sample_idx").cast("long").alias("sample_idx"), "label", "repetition", *channels).withColumns({"_pane": at, "_offset": F.col("sample_idx") % pane})
    rows = rows.withColumn("_block", F.explode(needed))

    by = Window.partitionBy(*KEYS, "_block").orderBy("sample_idx")
    steps = {}
    for c in channels:
        steps |= {f"_d_{c}": F.col(c) - F.lag(c, 1).over(by), f"_s_{c}": F.when(F.col(c) < 0, -1).otherwise(1)}
    rows = rows.withColumns(steps)
    steps = {}
    for c in channels:
        d, before, s, sign = F.col(f"_d_{c}"), F.lag(f"_d_{c}", 1).over(by), F.col(f"_s_{c}"), F.lag(f"_s_{c}", 1).over(by)
        steps[f"_z_{c}"] = ((s != sign) & (F.abs(d) > zc_threshold)).cast("double")
        steps[f"_t_{c}"] = ((before * d < 0) & (F.greatest(F.abs(before), F.abs(d)) > zc_threshold)).cast("double")
    rows = rows.withColumns(steps)

    inside, crossing = (lambda v, m: F.sum(F.when(F.col("_offset") >= m, v))), (lambda v, m: F.sum(F.when(F.col("_offset") < m, v)))
    state = [F.count(F.lit(1)).alias("n"), F.min("label").alias("least"), F.max("label").alias("most"), F.max_by("label", "sample_idx").alias("label"), F.max_by("repetition", "sample_idx").alias("repetition")]
    for c in channels:
        x, d = F.col(c), F.abs(f"_d_{c}")
        state += [
            F.transform(F.sort_array(F.collect_list(F.struct("sample_idx", x.alias("x")))), lambda v: v["x"]).alias(f"x_{c}"),
            *(f.alias(f"{name}_{c}") for name, f in {"n": F.count(x), "sum": F.sum(x), "abs": F.sum(F.abs(x)), "sq": F.sum(x * x), "m2": F.var_pop(x) * F.count(x), "avg": F.avg(x), "absmax": F.max(F.abs(x))}.items()),
            *(f(v, m).alias(f"{name}_{way}_{c}") for name, v, m in (("wl", d, 1), ("zcr", F.col(f"_z_{c}"), 1), ("ssc", F.col(f"_t_{c}"), 2)) for way, f in (("in", inside), ("edge", crossing))),
        ]
    panes = rows.groupBy(*KEYS, "_block", "_pane").agg(*state)

    trail = Window.partitionBy(*KEYS, "_block").orderBy("_pane")
    last = lambda v, n=k: F.sum(v).over(trail.rowsBetween(-(n - 1), 0)) if n > 0 else F.lit(0.0)
    total = lambda name, c, edges=k - 1: F.coalesce(last(f"{name}_in_{c}"), F.lit(0.0)) + F.coalesce(last(f"{name}_edge_{c}", edges), F.lit(0.0))
    whole = trail.rowsBetween(-(k - 1), 0)
    out = [*KEYS, "_block", "_pane", "label", "repetition", (F.min("least").over(whole) == F.max("most").over(whole)).alias("pure"), last("n").alias("_n")]
    for c in channels:
        n = last(f"n_{c}")
        mean, square = last(f"sum_{c}") / n, last(f"sq_{c}") / n
        spread = F.when(n == width, last(f"m2_{c}") / width + F.var_pop(f"avg_{c}").over(whole)).otherwise(F.greatest(F.lit(0.0), square - mean * mean))
        out += [
            F.filter(F.flatten(F.collect_list(f"x_{c}").over(whole)), lambda v: v.isNotNull()).alias(f"x_{c}"),
            F.sqrt(square).alias(f"rms_{c}"),
            (last(f"abs_{c}") / n).alias(f"mav_{c}"),
            (total("zcr", c) / (width - 1)).alias(f"zcr_{c}"),
            total("wl", c).alias(f"wl_{c}"),
            (total("ssc", c, k - 1 if pane > 1 else k - 2) / (width - 2)).alias(f"ssc_{c}"),
            F.sqrt(spread).alias(f"std_{c}"),
            mean.alias(f"mean_{c}"),
            F.max(f"absmax_{c}").over(whole).alias(f"absmax_{c}"),
        ]
    first = F.col("_pane") - (k - 1)
    hops = panes.select(*out).filter((first >= 0) & (first % hop == 0) & (F.col("_n") == width) & (F.expr(f"_pane div {per_block}") == F.col("_block")))
    return hops.withColumns({"start_idx": first * pane, "seq": F.expr(f"(_pane - {k - 1}) div {hop}")}).drop("_block", "_pane", "_n")


def binary_labels(df: DataFrame) -> DataFrame:
    return df.withColumn("label", (F.col("label") != 0).cast("int"))


def long_by_channel(windows: DataFrame, channels=CHANNELS, names=("x", "rms", "mav", "std", "mean", "absmax")) -> DataFrame:
    """One row per window and channel, with the channel's position among them."""
    part = lambda k, c: F.struct(F.lit(c).alias("channel"), F.lit(k).alias("position"), *(F.col(f"{n}_{c}").alias(n) for n in names))
    keep = [*KEYS, "seq", "label", "repetition", "pure"]
    return windows.select(*keep, F.explode(F.array(*(part(k, c) for k, c in enumerate(channels)))).alias("c")).select(*keep, "c.*")


def resample_labels(df: DataFrame, new_length: Column, old_length: Column) -> DataFrame:
    """Labels at new positions: position i takes old position trunc(i * old / new), the last at most; never interpolated."""
    sized = df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_old")).withColumn("n_new", new_length)
    grid = sized.select(*KEYS, "n_old", "n_new", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_new") - 1)).alias("i"))
    at = F.least((F.col("i") * F.col("n_old").cast("double") / F.col("n_new")).cast("long"), F.col("n_old") - 1)
    old = df.select(*KEYS, F.col("sample_idx").alias("at"), "label", "repetition")
    return grid.withColumn("at", at).join(old, [*KEYS, "at"]).select(*KEYS, "i", "label", "repetition")


def standardize(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """Columns less the training rows' mean, over their population deviation (0 counts as 1)."""
    stats = df.filter(train).agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    scale = lambda c: F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))
    return df.crossJoin(F.broadcast(stats)).withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / scale(c) for c in columns}).drop(*(f"_{n}_{c}" for c in columns for n in "ms"))
