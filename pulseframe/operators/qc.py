"""Rule-based signal quality of windows, and its accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.operators.dsp import mains_column
from pulseframe.operators.quantiles import exact_quantiles
from pulseframe.sources.signals import KEYS

DEFAULTS = {"flatline_std": 1e-6, "saturation_limit": 1.0, "max_saturated": 0.05, "min_clip_run": 5, "min_zero_run": 10, "min_rms": 1e-3, "max_rms": 5.0, "max_offset": 0.2, "max_mains": 0.5}
#: Limits that every window passes, for profiling.
WIDE_GATE = {"flatline_std": 0.0, "saturation_limit": 1e18, "min_rms": 0.0, "max_rms": 1e18, "max_offset": 1e18}


def over(value: Column, limit: Column) -> Column:
    """value > limit; an undefined value passes."""
    return (value > limit) & ~F.isnan(value)


def longest_run(x: Column, test) -> Column:
    """Longest run of consecutive elements that pass the test."""
    step = lambda s, v: F.struct(F.when(test(v), s["run"] + 1).otherwise(0).alias("run"), F.greatest(s["best"], F.when(test(v), s["run"] + 1).otherwise(0)).alias("best"))
    return F.aggregate(x, F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")), step, lambda s: s["best"])


def saturated_fraction(x: Column, limit: Column) -> Column:
    hits = F.filter(x, lambda v: (F.abs(v) >= limit) & ~F.isnan(v))
    return F.size(hits) / F.size(x)


def reasons(limits: dict[str, Column], x="x", std="std", mean="mean", rms="rms", rate: float | None = None, mains: float = 50.0) -> dict[str, Column]:
    """Failed check -> condition, in the order in which failures are listed; interference from the mains is judged where a sample rate is given."""
    x, std, mean, rms = map(F.col, (x, std, mean, rms))
    near_zero = F.greatest(F.lit(1e-6), std * 0.01)
    out = {
        "dropout": (std < limits["flatline_std"]) & ~F.isnan(std),
        "dropout_run": longest_run(x, lambda v: F.abs(v) < near_zero) >= limits["min_zero_run"],
        "saturation": over(saturated_fraction(x, limits["saturation_limit"]), limits["max_saturated"]),
        "clipping": longest_run(x, lambda v: (F.abs(v) >= limits["saturation_limit"]) & ~F.isnan(v)) >= limits["min_clip_run"],
        "amplitude_low": (rms < limits["min_rms"]) & ~F.isnan(rms),
        "amplitude_high": over(rms, limits["max_rms"]),
        "baseline_offset": over(F.abs(mean), limits["max_offset"]),
    }
    if rate is not None:
        out["powerline"] = over(mains_column(x, rate, mains), limits["max_mains"])
    return out


def places(channels: list[str], wanted: list[int] | tuple[int, ...] | None) -> list[str]:
    """The wanted channels, given by their places (None: all); a place that there isn't is an error."""
    if wanted is None:
        return channels
    if bad := [k for k in wanted if not 0 <= k < len(channels)]:
        raise IndexError(f"no such channels: {bad}")
    return [channels[k] for k in wanted]


def of_channels(by_channel: DataFrame, channels: list[str], wanted: list[int] | None) -> DataFrame:
    """The rows of the wanted channels, given by their places among the channels."""
    return by_channel if wanted is None else by_channel.filter(F.col("channel").isin(places(channels, wanted)))


def named_failures(found: dict[str, Column]) -> Column:
    """The names of the conditions that hold; a run of zeros counts as dropout."""
    return F.array_compact(F.array(*(F.when(c, F.lit("dropout" if k == "dropout_run" else k)) for k, c in found.items())))


def judge(windows: DataFrame, channels: list[str], lim: dict[str, Column], rate: float | None = None, mains: float = 50.0) -> DataFrame:
    """Add failures (distinct reasons over the channels, in their order) and valid to windows with x_, std_, mean_ and rms_<channel>; no row moves."""
    each = [named_failures(reasons(lim, f"x_{c}", f"std_{c}", f"mean_{c}", f"rms_{c}", rate, mains)) for c in channels]
    return windows.withColumn("failures", F.array_distinct(F.concat(F.array().cast("array<string>"), *each))).withColumn("valid", F.size("failures") == 0)


def limits(**given) -> dict[str, Column]:
    return {k: v if isinstance(v, Column) else F.lit(v) for k, v in (DEFAULTS | given).items()}


def channel_failures(df: DataFrame, lim: dict[str, Column], rate: float | None = None) -> DataFrame:
    """Add failures: distinct reasons of a window's channel, in the order of the checks; a run of zeros counts as dropout."""
    return df.withColumn("failures", F.array_distinct(named_failures(reasons(lim, rate=rate))))


def window_failures(by_channel: DataFrame) -> DataFrame:
    """One row per window: reasons over its channels in order of their positions, each once."""
    listed = F.array_sort(F.collect_list(F.struct("position", "failures")))
    grouped = by_channel.groupBy(*KEYS, "seq", "label").agg(listed.alias("l"))
    return grouped.select(*KEYS, "seq", "label", F.array_distinct(F.flatten(F.col("l.failures"))).alias("failures")).withColumn("valid", F.size("failures") == 0)


def gate(std: Column, saturated: Column, lim: dict[str, Column]) -> Column:
    """The first failed check of the safety path, or null."""
    return F.when((std < lim["flatline_std"]) & ~F.isnan(std), "dropout").when(over(saturated, lim["max_saturated"]), "saturation")


def rate(rejected: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(rejected.cast("double"), total), F.lit(0.0))


def account(windows: DataFrame, *by: str) -> DataFrame:
    """total, kept, rejected, rejection_rate by keys (all rows if none). A window with two reasons is rejected once."""
    out = windows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if("valid").alias("kept"))
    return out.withColumn("rejected", F.col("total") - F.col("kept")).withColumn("rejection_rate", rate(F.col("rejected"), F.col("total")))


def account_reasons(windows: DataFrame, *by: str) -> DataFrame:
    """Windows by reason: a window counts under each of its reasons."""
    return windows.select(*by, F.explode("failures").alias("reason")).groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n"))


def one_row(df: DataFrame, values: dict) -> DataFrame:
    return df.sparkSession.createDataFrame([tuple(values.values())], ", ".join(f"`{k}` double" for k in values))


def thresholds(profile: DataFrame, margin: float = 3.0, low: float = 0.1) -> DataFrame:
    """One row of limits from the pooled amplitudes of windows and channels."""
    q = exact_quantiles(profile, {"low": (F.col("rms"), 0.001), "rms": (F.col("rms"), 0.999), "offset": (F.abs("mean"), 0.999), "peak": (F.col("absmax"), 0.999)})
    times = lambda v, k: None if v is None else v * k
    return one_row(profile, {"min_rms": times(q["low"], low), "flatline_std": times(q["low"], low), "max_rms": times(q["rms"], margin), "max_offset": times(q["offset"], margin), "saturation_limit": times(q["peak"], margin)})


def corruption_settings(profile: DataFrame, severity: float = 3.0) -> DataFrame:
    """One row: the rail, the typical amplitude and the strengths of the injected faults; nulls for an empty profile."""
    q = exact_quantiles(profile, {"peak": (F.col("absmax"), 0.999), "typical": (F.col("rms"), 0.5)})
    if q["peak"] is None or q["typical"] is None:
        return one_row(profile, dict.fromkeys(("rail", "typical", "gain", "offset")))
    rail = q["peak"] * severity
    return one_row(profile, {"rail": rail, "typical": q["typical"], "gain": 10.0 if q["typical"] == 0 else severity * rail / q["typical"], "offset": q["typical"] * severity})


#: Threshold -> quantile and quantity that it follows from, and whether the low factor or the margin multiplies it.
FOLLOWS = {"min_rms": (0.001, "window RMS", "low"), "flatline_std": (0.001, "window RMS", "low"), "max_rms": (0.999, "window RMS", "margin"), "max_offset": (0.999, "abs of window mean", "margin"), "saturation_limit": (0.999, "window peak", "margin")}


def derivation(name: str, margin: float = 3.0, low: float = 0.1) -> str:
    """How a threshold follows from the profile, for the record."""
    q, of, factor = FOLLOWS[name]
    return f"{low if factor == 'low' else margin:g} times the {q:g} quantile of {of}"


PROFILED = (0.1, 1.0, 50.0, 99.0, 99.9)


def calibrate(profile: DataFrame, margin: float = 3.0) -> DataFrame:
    """Rows (section, name, value, derivation): percentiles of the profile, thresholds with how they follow, and strengths of faults."""
    amplitudes = {"rms": F.col("rms"), "abs_mean": F.abs("mean"), "abs_max": F.col("absmax")}
    q = exact_quantiles(profile, {f"{a}_p{p:g}".replace(".", "_"): (c, p / 100) for a, c in amplitudes.items() for p in PROFILED})
    rows = [("profile", "n", float(profile.count()), None)] + [("profile", k, v, None) for k, v in q.items()]
    rows += [("thresholds", k, v, derivation(k, margin)) for k, v in thresholds(profile, margin).first().asDict().items()]
    rows += [("faults", k, v, None) for k, v in corruption_settings(profile).first().asDict().items()]
    return profile.sparkSession.createDataFrame(rows, "section string, name string, value double, derivation string")
