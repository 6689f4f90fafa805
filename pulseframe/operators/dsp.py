"""Filters and resampling of whole recordings, as passes over their sorted rows."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions.arrays import by_length
from pulseframe.operators.windows import resample_labels
from pulseframe.sources.signals import KEYS, PreprocessConfig


def butterworth_bandpass(low: float, high: float, rate: float, order: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Digital coefficients (b, a) by the bilinear transform of the analogue prototype."""
    if not 0 < low < high < rate / 2:
        raise ValueError("the band must lie between 0 and half the sample rate")
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    w1, w2 = (2 * rate * np.tan(np.pi * f / rate) for f in (low, high))
    half, centre = poles * (w2 - w1) / 2, w1 * w2
    root = np.sqrt(half**2 - centre + 0j)
    analogue = np.concatenate([half + root, half - root])
    gain = (w2 - w1) ** order
    digital = (2 * rate + analogue) / (2 * rate - analogue)
    zeros = np.concatenate([np.ones(order), -np.ones(order)])
    k = gain * np.prod(2 * rate - np.zeros(order)) / np.prod(2 * rate - analogue)
    return np.real(k * np.poly(zeros)), np.real(np.poly(digital))


def notch(freq: float, rate: float, q: float = 30.0) -> tuple[np.ndarray, np.ndarray]:
    w = 2 * np.pi * freq / rate
    beta = np.tan(w / q / 2)
    g = 1 / (1 + beta)
    return g * np.array([1, -2 * np.cos(w), 1]), np.array([1, -2 * g * np.cos(w), 2 * g - 1])


class BlockFilter:
    """A linear filter (b, a) over columns of samples, in blocks: the outputs of a block and the state
    after it are matrices times its inputs and the state before, so that no sample is handled alone."""

    def __init__(self, b: np.ndarray, a: np.ndarray, block: int = 64):
        order = len(a) - 1
        step = np.zeros((order, order))
        step[:, 0] = -a[1:]
        step[np.arange(order - 1), np.arange(1, order)] = 1
        drive, direct = b[1:] - a[1:] * b[0], b[0]
        powers = [np.eye(order)]
        for _ in range(block):
            powers.append(powers[-1] @ step)
        self.block, self.order, self.powers = block, order, powers
        self.seen = np.array([p[0] for p in powers[:block]])  # state -> outputs
        response = np.concatenate([[direct], [p[0] @ drive for p in powers[: block - 1]]])
        lag = np.arange(block)[:, None] - np.arange(block)[None, :]
        self.response = np.where(lag >= 0, response[np.maximum(lag, 0)], 0.0)  # inputs -> outputs
        self.into = np.array([powers[block - 1 - k] @ drive for k in range(block)]).T  # inputs -> state
        #: The state in which a constant input of 1 has always been.
        self.steady = np.linalg.solve(np.eye(order) - step, drive)

    def __call__(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outputs of x (samples by columns), and the state (order by columns) after it."""
        out = np.empty_like(x)
        for at in range(0, len(x), self.block):
            part = x[at:at + self.block]
            n = len(part)
            out[at:at + n] = self.seen[:n] @ state + self.response[:n, :n] @ part
            state = self.powers[n] @ state + self.into[:, self.block - n:] @ part
        return out, state


def padding(b: np.ndarray, a: np.ndarray) -> int:
    """Samples by which a recording is extended at either end."""
    return 3 * max(len(a), len(b))


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward over an odd extension, from the steady state of its first value."""
    n = padding(b, a)
    if len(x) <= n:
        raise ValueError(f"a recording needs more than {n} samples")
    run = BlockFilter(b, a)
    long = np.concatenate([2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2:-n - 2:-1]])[:, None]
    for _ in range(2):
        long = run(long, run.steady[:, None] * long[0])[0][::-1]
    return long[n:-n, 0]


def ratio_of(rate: float, target: float) -> tuple[int, int]:
    ratio = Fraction(target / rate).limit_denominator(1000)
    return ratio.numerator, ratio.denominator


def low_pass(up: int, down: int) -> np.ndarray:
    """Taps of the Kaiser-windowed sinc between insertion of zeros and decimation."""
    half = 10 * max(up, down)
    t = np.arange(-half, half + 1)
    taps = np.sinc(t / max(up, down)) * np.kaiser(len(t), 5.0)
    return taps * up / taps.sum()


def resample(x: np.ndarray, rate: float, target: float) -> np.ndarray:
    """Polyphase: a Kaiser-windowed sinc between insertion of zeros and decimation; ceil(n * up / down) samples."""
    up, down = ratio_of(rate, target)
    if abs(target - rate) < 1e-9:
        return x
    taps = low_pass(up, down)
    half = len(taps) // 2
    spread = np.zeros(len(x) * up)
    spread[::up] = x
    return np.convolve(spread, taps)[half:half + len(spread)][::down][: -(-len(x) * up // down)]


def recordings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list | None, np.ndarray, np.ndarray, pa.Schema]]:
    """Parts of recordings from rows (keys, sample_idx, signals) that come recording by recording:
    the keys where a recording begins, else None; positions; signals as samples by columns; the schema of the rows."""
    n, last = len(KEYS), None
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(n))))
        cuts = [k for k in range(len(keys)) if keys[k] != (keys[k - 1] if k else last)]
        index = batch.column(n).to_numpy()
        signals = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(n + 1, batch.num_columns)]).astype(float)
        for a, b in zip([0, *cuts], [*cuts, len(keys)]):
            if a < b:
                yield list(keys[a]) if a in cuts else None, index[a:b], signals[a:b], batch.schema
        last = keys[-1] if keys else last


def rows_of(keys: list, index: np.ndarray, signals: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array([k] * len(index), t) for k, t in zip(keys, schema.types)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(index, pa.int64()), *(pa.array(np.ascontiguousarray(c), pa.float64()) for c in signals.T)], schema.names)


def forward_pass(b: np.ndarray, a: np.ndarray, short: str = "error"):
    """Filters rows in order of time and adds those of the odd extension at the end. A task keeps the
    filter's state and the samples that the extensions need, whatever the length of a recording.
    A recording no longer than the extension is an error, or comes out undefined (short="nan")."""
    pad = padding(b, a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt, keys, names = BlockFilter(b, a), None, None
        state = held = None  # held: the first samples until there are enough to begin, then the last ones
        done = 0

        def end() -> Iterator[pa.RecordBatch]:
            if keys is not None:
                if state is None:
                    if short == "error":
                        raise ValueError(f"a recording needs more than {pad} samples")
                    n = len(held) + pad
                    yield rows_of(keys, np.arange(n), np.full((n, held.shape[1]), np.nan), names)
                    return
                yield rows_of(keys, np.arange(done, done + pad), filt(2 * held[-1] - held[-2:-pad - 2:-1], state)[0], names)

        for begins, _, x, schema in recordings(batches):
            if begins:
                yield from end()
                keys, names, state, held, done = begins, schema, None, x[:0], 0
            held = np.concatenate([held, x])
            if state is None:
                if len(held) <= pad:
                    continue
                lead = 2 * held[0] - held[pad:0:-1]
                state, x = filt(lead, filt.steady[:, None] * lead[0])[1], held
            out, state = filt(x, state)
            yield rows_of(keys, np.arange(done, done + len(x)), out, names)
            done += len(x)
            held = held[-pad - 1:]
        yield from end()

    return run


def backward_pass(b: np.ndarray, a: np.ndarray):
    """Filters rows in reverse order of time, and drops those of the extension, which come first."""
    pad = padding(b, a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt, keys, state, skip = BlockFilter(b, a), None, None, 0
        for begins, index, x, schema in recordings(batches):
            if begins:
                keys, state, skip = begins, filt.steady[:, None] * x[0], pad
            out, state = filt(x, state)
            if skip < len(x):
                yield rows_of(keys, index[skip:], out[skip:], schema)
            skip = max(0, skip - len(x))

    return run


def resampling_pass(up: int, down: int):
    """Polyphase resampling of rows in order of time; a task keeps the samples under the taps."""
    taps = low_pass(up, down)
    half = len(taps) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = names = held = None
        base = made = 0  # position of held[0], and outputs so far

        def outputs(until: int) -> np.ndarray:
            """Outputs from made to until, from what is held: output m is at m * down among the samples with up - 1 zeros after each."""
            at = np.arange(made, until) * down
            first = -(-(at - half) // up)  # the first sample under the taps
            k = first[:, None] + np.arange(2 * half // up + 1)[None, :]
            tap = at[:, None] - k * up + half
            used = (tap >= 0) & (k >= base) & (k < base + len(held))
            weights = np.where(used, taps[np.clip(tap, 0, len(taps) - 1)], 0.0)
            return np.einsum("ij,ijc->ic", weights, held[np.clip(k - base, 0, len(held) - 1)])

        def end() -> Iterator[pa.RecordBatch]:
            if keys is not None and (until := -(-(base + len(held)) * up // down)) > made:
                yield rows_of(keys, np.arange(made, until), outputs(until), names)

        for begins, _, x, schema in recordings(batches):
            if begins:
                yield from end()
                keys, names, held, base, made = begins, schema, x[:0], 0, 0
            held = np.concatenate([held, x])
            # Outputs whose taps end within what has come.
            until = max(made, ((base + len(held) - 1) * up - half) // down + 1)
            if until > made:
                yield rows_of(keys, np.arange(made, until), outputs(until), names)
                made = until
                first = max(base, -(-(made * down - half) // up))
                held, base = held[first - base:], first
        yield from end()

    return run


def signal_rows(df: DataFrame, channels) -> DataFrame:
    """(keys, sample_idx, channels), a recording in one partition."""
    return df.select(*KEYS, F.col("sample_idx").cast("long").alias("sample_idx"), *(F.col(c).cast("double").alias(c) for c in channels)).repartition(*KEYS)


def in_order(df: DataFrame, run, backward: bool = False) -> DataFrame:
    """The pass over each recording's rows by time; partitions stay as they are, and are sorted on disk if need be."""
    ordered = df.sortWithinPartitions(*KEYS, F.col("sample_idx").desc() if backward else "sample_idx")
    return ordered.mapInArrow(run, df.schema)


def resample_recordings(df: DataFrame, rate: float, target: float, channels=("ch0", "ch1")) -> DataFrame:
    """Recordings at the target rate: keys, sample_idx, label, repetition and the channels.

    Signals are resampled with zeros beyond their ends; labels and repetitions are those of
    the old position trunc(i * old / new), never interpolated. Equal rates change nothing.
    """
    keep = [*KEYS, "sample_idx", "label", "repetition", *channels]
    if abs(target - rate) < 1e-9:
        return df.select(*keep)
    up, down = ratio_of(rate, target)
    signals = in_order(signal_rows(df, channels), resampling_pass(up, down))
    labels = resample_labels(df, F.ceil(F.col("n_old") * up / down).cast("long"), F.col("n_old")).withColumnRenamed("i", "sample_idx")
    return signals.join(labels, [*KEYS, "sample_idx"]).select(*keep)


def filter_recordings(df: DataFrame, rate: float, band: tuple[float, float] | None = (20.0, 450.0), mains: float | None = 50.0, channels=("ch0", "ch1"), short: str = "error") -> DataFrame:
    """Band-pass, then notch, each channel of each recording forward and backward; either may be None.

    A filter is a pass in order of time and one in reverse, so a recording of any length
    takes bounded memory in its task. One that is no longer than a filter's extension stops
    the job with a ValueError (short="error") or keeps its rows with NaN for signals (short="nan").
    """
    if short not in ("error", "nan"):
        raise ValueError(short)
    stages = [butterworth_bandpass(*band, rate)] if band else []
    stages += [notch(mains, rate)] if mains else []
    if not stages:
        return df
    signals = signal_rows(df, channels)
    for b, a in stages:
        signals = in_order(in_order(signals, forward_pass(b, a, short)), backward_pass(b, a), backward=True)
    rest = df.drop(*channels).withColumn("sample_idx", F.col("sample_idx").cast("long"))
    return rest.join(signals, [*KEYS, "sample_idx"]).select(*df.columns)


def preprocess(df: DataFrame, config: PreprocessConfig, rate: float, channels=("ch0", "ch1"), short: str = "error") -> DataFrame:
    """Resample to the configured rate, then band-pass, then notch; short recordings as in filter_recordings."""
    return filter_recordings(resample_recordings(df, rate, config.target_sample_rate, channels), config.target_sample_rate, config.bandpass_hz, config.notch_hz, channels, short)


def mains_shares(x: np.ndarray, rate: float, mains: float = 50.0, width: float = 5.0) -> np.ndarray:
    """Of windows of one length (a row each) the share of the power density (Hann segments, half overlapped) within width of mains; 0 if it can't be told."""
    size = x.shape[1]
    n = min(1024, size)
    if size < 16 or rate <= 2 * mains:
        return np.zeros(len(x))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    parts = np.stack([x[:, k:k + n] for k in range(0, size - n + 1, n - n // 2)], axis=1)
    power = (np.abs(np.fft.rfft((parts - parts.mean(axis=2, keepdims=True)) * window, axis=2)) ** 2).mean(axis=1)
    power[:, 1:-1 if n % 2 == 0 else None] *= 2
    f = np.fft.rfftfreq(n, 1 / rate)
    total, near = np.trapezoid(power, f, axis=1), np.abs(f - mains) <= width
    return np.where(total > 0, np.trapezoid(power[:, near], f[near], axis=1) / np.where(total > 0, total, 1.0), 0.0)


def mains_share(x: np.ndarray, rate: float, mains: float = 50.0, width: float = 5.0) -> float:
    return float(mains_shares(np.asarray(x, float)[None, :], rate, mains, width)[0])


def mains_column(x: Column, rate: float, mains: float = 50.0, width: float = 5.0) -> Column:
    """mains_share of an array column, the windows of one length at a time."""

    @F.pandas_udf("double")
    def shares(windows: pd.Series) -> pd.Series:
        return pd.Series(by_length(windows, lambda w: mains_shares(w, rate, mains, width)), dtype=float)

    return shares(x)
