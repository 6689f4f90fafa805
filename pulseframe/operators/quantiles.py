"""Exact quantiles of whole columns without meeting in one task: counts by bin, then the values of the bins that matter."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

#: Bins of a pass, and values that may come to the driver for a quantile.
BINS, FETCHED = 1024, 20_000
#: Magnitudes up to TINY share a bin of logarithms; OFFSET makes the logarithms of all others positive.
TINY, OFFSET = 1e-300, 700.0


def bin_in(name: str, least: float, most: float) -> Column:
    """The bin of a value between two others, which is never less for a greater value; the two are in different bins."""
    c = F.col(name)
    span = most / BINS - least / BINS
    if least < 0 < most or max(abs(least), abs(most)) > 1000 * min(abs(least), abs(most)):
        magnitude = lambda v: F.when(F.abs(v) > TINY, F.signum(v) * (F.ln(F.abs(v)) + OFFSET)).otherwise(0.0)
        known = lambda v: math.copysign(math.log(abs(v)) + OFFSET, v) if abs(v) > TINY else 0.0
        if known(most) - known(least) > 1e-6:
            return F.least(F.lit(BINS - 1), F.floor((magnitude(c) - known(least)) / ((known(most) - known(least)) / BINS)).cast("int"))
    if span == 0:  # ends so close that their distance can't be divided
        return (c > least).cast("int")
    return F.least(F.lit(BINS - 1), F.floor((c - least) / span).cast("int"))


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[Column, float]]) -> dict[str, float | None]:
    """name -> linearly interpolated quantile of (column, q) over the rows where it isn't null; None without any.

    Each pass counts values by bins, in one aggregation for all columns, and goes on inside
    the bins of the two ranks beside the quantile, until few values are left in them. So no task
    and no fetch sees more than a bounded number of values. Bins are equal, but of logarithms where a span's values
    differ in magnitude, so that a handful of passes do for any doubles. Infinities are counted apart; NaN counts as the largest value.
    """
    columns = {name: column.cast("double") for name, (column, _) in wanted.items()}
    data = df.select(*(c.alias(n) for n, c in columns.items())).persist(StorageLevel.DISK_ONLY)
    try:
        number = lambda c: F.when(F.abs(c) < math.inf, F.col(c))
        ends = data.agg(
            *(f(number(n)).alias(f"{n}_{k}") for n in columns for k, f in (("least", F.min), ("most", F.max), ("n", F.count))),
            *(F.count_if(F.col(n) == v).alias(f"{n}_{k}") for n in columns for k, v in (("low", -math.inf), ("high", math.inf))),
            *(F.count(n).alias(f"{n}_all") for n in columns),
        ).first()
        found: dict[tuple[str, int], float] = {}
        open_ = []  # (name, rank, least, most, values below least)
        for name, (_, q) in wanted.items():
            if n := ends[f"{name}_all"]:
                for rank in {math.floor(q * (n - 1)), math.ceil(q * (n - 1))}:
                    low, finite, high = ends[f"{name}_low"], ends[f"{name}_n"], ends[f"{name}_high"]
                    if low <= rank < low + finite:
                        open_.append((name, rank, ends[f"{name}_least"], ends[f"{name}_most"], low, finite))
                    else:
                        found[name, rank] = -math.inf if rank < low else math.inf if rank < low + finite + high else math.nan
        while open_:
            spans = sorted({(name, least, most) for name, _, least, most, _, n in open_ if n > FETCHED and least < most})
            inside = lambda name, least, most: F.col(name).between(least, most)
            marks = [F.when(inside(*s), F.struct(F.lit(k).alias("k"), bin_in(*s).alias("bin"), F.col(s[0]).alias("v"))) for k, s in enumerate(spans)]
            counts: dict[int, list] = {}
            if marks:
                cells = data.select(F.explode(F.array_compact(F.array(*marks))).alias("m")).groupBy("m.k", "m.bin")
                for r in cells.agg(F.count(F.lit(1)).alias("n"), F.min("m.v").alias("least"), F.max("m.v").alias("most")).collect():
                    counts.setdefault(r.k, []).append(r)
            few = sorted({(name, least, most) for name, _, least, most, _, n in open_ if n <= FETCHED and least < most})
            values: dict[tuple, list] = {}
            if few:  # one job fetches the values of all spans that have few
                marks = [F.when(inside(*s), F.struct(F.lit(k).alias("k"), F.col(s[0]).alias("v"))) for k, s in enumerate(few)]
                for k, v in sorted(tuple(r.m) for r in data.select(F.explode(F.array_compact(F.array(*marks))).alias("m")).collect()):
                    values.setdefault(few[k], []).append(v)
            rest = []
            for name, rank, least, most, below, n in open_:
                if least == most:
                    found[name, rank] = least
                elif n <= FETCHED:
                    found[name, rank] = values[name, least, most][rank - below]
                else:
                    for r in sorted(counts[spans.index((name, least, most))], key=lambda r: r.bin):
                        if rank < below + r.n:
                            rest.append((name, rank, r.least, r.most, below, r.n))
                            break
                        below += r.n
            open_ = rest
    finally:
        data.unpersist()
    out: dict[str, float | None] = {}
    for name, (_, q) in wanted.items():
        if n := ends[f"{name}_all"]:
            at = q * (n - 1)
            low, high = found[name, math.floor(at)], found[name, math.ceil(at)]
            out[name] = low if low == high or at == math.floor(at) else low + (high - low) * (at - math.floor(at))
        else:
            out[name] = None
    return out
