"""Features and injected faults of windows held as arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODES = ("dropout", "saturation", "clipping", "baseline_offset", "noise_burst")


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def rms(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x))


def mav(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + F.abs(v)) / F.size(x)


def kurtosis(x: Column) -> Column:
    """Fourth standardised moment (3 for a normal distribution); 0 without variance.

    Two folds: the mean, then both moments about it.
    """
    def moments(m: Column) -> Column:
        step = lambda s, v: F.struct((s["second"] + (v - m) * (v - m)).alias("second"), (s["fourth"] + (v - m) * (v - m) * (v - m) * (v - m)).alias("fourth"))
        finish = lambda s: F.when(s["second"] == 0, 0.0).otherwise(s["fourth"] * F.size(x) / (s["second"] * s["second"]))
        return F.aggregate(x, F.struct(F.lit(0.0).alias("second"), F.lit(0.0).alias("fourth")), step, finish)

    return F.transform(F.array(mean(x)), moments)[0]  # the mean is computed once and bound


def crest(x: Column) -> Column:
    r = rms(x)
    return F.when(r == 0, 0.0).otherwise(F.aggregate(x, F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v))) / r)


def sub_window_rms(x: Column, parts: int = 10) -> Column:
    """Largest rms of equal sub-blocks (remainder cut off) over that of the whole; 1 if too short or silent.

    Sums of squares a block and of the whole; roots are taken of the two results only.
    """
    m = F.floor(F.size(x) / parts).cast("int")
    squares = lambda v: F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y)
    most = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: squares(F.slice(x, (k * m + 1).cast("int"), m))))
    r = rms(x)
    return F.when((F.size(x) < parts) | (r == 0), 1.0).otherwise(F.sqrt(most / m) / r)


def steps(x: Column) -> Column:
    """Differences of neighbours."""
    n = F.size(x)
    return F.zip_with(F.slice(x, 1, F.greatest(n - 1, F.lit(0))), F.slice(x, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: b - a)


def share(hits: Column, of: Column) -> Column:
    return F.when(of > 0, total(F.transform(hits, lambda h: h.cast("double"))) / of).otherwise(0.0)


def zcr(x: Column, threshold: float = 0.0) -> Column:
    """Share of steps that cross zero by more than threshold; zero counts as positive."""
    n = F.greatest(F.size(x) - 1, F.lit(0))
    crosses = F.zip_with(F.slice(x, 1, n), F.slice(x, 2, n), lambda a, b: ((a < 0) != (b < 0)) & (F.abs(b - a) > threshold))
    return share(crosses, n)


def wl(x: Column) -> Column:
    """Length of the waveform."""
    return total(F.transform(steps(x), F.abs))


def ssc(x: Column, threshold: float = 0.0) -> Column:
    """Share of inner samples at which the slope changes its sign."""
    d, n = steps(x), F.greatest(F.size(x) - 2, F.lit(0))
    turns = F.zip_with(F.slice(d, 1, n), F.slice(d, 2, n), lambda a, b: (a * b < 0) & (F.greatest(F.abs(a), F.abs(b)) > threshold))
    return share(turns, n)


def by_length(x: pd.Series, f) -> list:
    """f of the windows of one length at a time, as a two-dimensional array."""
    out, length = [None] * len(x), x.map(len).to_numpy()
    for n in np.unique(length):
        rows = np.flatnonzero(length == n)
        for row, value in zip(rows, f(np.array([x.iloc[k] for k in rows], float).reshape(len(rows), n))):
            out[row] = value
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def psd(x: pd.Series) -> pd.Series:
    """Power of the mean-removed window at 0, rate / n, 2 * rate / n, ... up to half the rate; empty for an empty window."""
    power = lambda w: np.abs(np.fft.rfft(w - w.mean(axis=1, keepdims=True), axis=1)) ** 2 if w.shape[1] else w
    return pd.Series(by_length(x, power))


def mean_frequency(power: Column, n: Column, rate: float) -> Column:
    """Mean frequency of a psd of n samples; 0 without power."""
    s = total(power)
    return F.when(s > 0, total(F.transform(power, lambda p, k: p * k * F.lit(rate) / n)) / s).otherwise(0.0)


def high_frequency_ratio(power: Column, n: Column, rate: float, from_hz: float = 150.0) -> Column:
    """Share of the power from 150 Hz; 0 without power."""
    s = total(power)
    return F.when(s > 0, total(F.transform(power, lambda p, k: F.when(k * F.lit(rate) / n >= from_hz, p).otherwise(0.0))) / s).otherwise(0.0)


TIME_FEATURES = {"rms": rms, "mav": mav, "zcr": zcr, "wl": wl, "ssc": ssc}
ANOMALY_FEATURES = (*TIME_FEATURES, "mnf", "hfr", "kurt", "crest", "sw_rms")


def batch_features(df: DataFrame, channels: dict[str, str], features: tuple[str, ...] = tuple(TIME_FEATURES), threshold: float = 0.0) -> DataFrame:
    """Add <feature>_<channel> for the array columns (channel -> column), features outermost.

    A name that isn't one of TIME_FEATURES, or a column that isn't an array of numbers, is an error.
    """
    if unknown := sorted(set(features) - set(TIME_FEATURES)):
        raise ValueError(f"no such features: {unknown}")
    for column in channels.values():
        kind = df.schema[column].dataType
        if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.NumericType):
            raise ValueError(f"{column} doesn't hold windows of one channel")
    given = lambda f: {"threshold": threshold} if f in ("zcr", "ssc") else {}
    return df.withColumns({f"{f}_{c}": TIME_FEATURES[f](F.col(x), **given(f)) for f in features for c, x in channels.items()})


def anomaly_features(df: DataFrame, x: str, rate: float, sub_windows: int = 10) -> DataFrame:
    """Add the ten columns of ANOMALY_FEATURES, in that order."""
    w = F.col(x)
    out = df.withColumn("_psd", psd(w)).withColumns({f: one(w) for f, one in TIME_FEATURES.items()})
    n = F.size(w)
    out = out.withColumns({"mnf": mean_frequency(F.col("_psd"), n, rate), "hfr": high_frequency_ratio(F.col("_psd"), n, rate)})
    return out.withColumns({"kurt": kurtosis(w), "crest": crest(w), "sw_rms": sub_window_rms(w, sub_windows)}).drop("_psd")


def span(n: int, start: float, length: float) -> tuple[int, int]:
    """First and last + 1 sample of a fault; one sample at least."""
    clip = lambda v: min(max(v, 0.0), 1.0)
    a = int(clip(start) * n)
    return a, max(int(clip(start + length) * n), a + 1)


def noise(n: int, a: int, b: int, seed: int = 0) -> list[float]:
    """Standard normal noise from a to b, zeros elsewhere."""
    out = np.zeros(n)
    out[a:b] = np.random.default_rng(seed).standard_normal(b - a)
    return out.tolist()


def inject(x: Column, mode: str, n: int, limit=1.0, gain=10.0, amount=0.5, start=None, length=None, seed: int = 0) -> Column:
    """The window with a fault; noise is the same for every window with the same seed."""
    at = {"dropout": (0.4, 0.2), "clipping": (0.3, 0.1), "noise_burst": (0.5, 0.15)}.get(mode, (0.0, 1.0))
    a, b = span(n, at[0] if start is None else start, at[1] if length is None else length)
    limit, gain, amount = (v if isinstance(v, Column) else F.lit(float(v)) for v in (limit, gain, amount))
    inside = lambda i: (i >= a) & (i < b)
    if mode == "dropout":
        return F.transform(x, lambda v, i: F.when(inside(i), 0.0).otherwise(v))
    if mode == "saturation":
        return F.transform(x, lambda v: F.greatest(-limit, F.least(limit, v * gain)))
    if mode == "clipping":
        return F.transform(x, lambda v, i: F.when(inside(i), limit).otherwise(v))
    if mode == "baseline_offset":
        return F.transform(x, lambda v: v + amount)
    if mode == "noise_burst":
        return F.zip_with(x, F.array(*map(F.lit, noise(n, a, b, seed))), lambda v, e: v + amount * e)
    raise ValueError(f"no such fault: {mode}")
