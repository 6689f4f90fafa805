"""Accuracy, calibration and safety of predictions (y_true, y_pred, confidence), by any keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REST = 0
LOW, HIGH = 0.4, 0.7
#: Edges of ten equal bins as doubles; three of them aren't the nearest to their decimal.
EDGES = [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0]


def gate_allows(c: Column, low: float = LOW) -> Column:
    return c >= low


def gate_scale(c: Column, low: float = LOW, high: float = HIGH) -> Column:
    """Share of assistance: 0 below low, 1 from high, linear between; at low itself allowed, with 0."""
    ramp = (c - low) / (high - low) if high > low else F.lit(1.0)
    return F.when(c < low, 0.0).when(c < high, ramp).otherwise(1.0)


def accuracy(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))


def balanced_accuracy(df: DataFrame, *by: str) -> DataFrame:
    """Mean recall of the classes that occur."""
    recall = df.groupBy(*by, "y_true").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("recall"))
    return recall.groupBy(*by).agg(F.avg("recall").alias("balanced_accuracy"))


def bin_of(c: Column) -> Column:
    """Bin 0 reaches from below to its upper edge inclusive, the others from above their lower edge."""
    out = F.lit(9)
    for k in range(8, -1, -1):
        out = F.when(c <= EDGES[k + 1], k).otherwise(out)
    return out


def reliability(df: DataFrame, *by: str) -> DataFrame:
    """Ten bins a group: n, mean confidence and accuracy, NaN where empty."""
    spark = df.sparkSession
    edges = spark.createDataFrame([(k, EDGES[k], EDGES[k + 1]) for k in range(10)], "bin int, low double, high double")
    found = df.withColumn("bin", bin_of(F.col("confidence"))).groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy")
    )
    grid = F.broadcast(edges) if not by else df.select(*by).distinct().crossJoin(F.broadcast(edges))
    nan = F.lit(float("nan"))
    out = grid.join(found, [*by, "bin"], "left")
    return out.select(*by, "bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean_confidence", nan).alias("mean_confidence"), F.coalesce("accuracy", nan).alias("accuracy"))


def expected_calibration_error(df: DataFrame, *by: str) -> DataFrame:
    bins = reliability(df, *by).filter("n > 0")
    gap = F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))) / F.sum("n")
    return bins.groupBy(*by).agg(gap.alias("ece"))


def assists(low: float = LOW, high: float = HIGH, gate=None) -> Column:
    """Whether a prediction leads to assistance: it is no rest, and the gate gives its confidence a scale above 0.
    gate is any function of the confidence's column that gives a column; by default gate_scale between low and high."""
    scale = gate(F.col("confidence")) if gate else gate_scale(F.col("confidence"), low, high)
    return (scale > 0) & (F.col("y_pred") != REST)


def safety(df: DataFrame, *by: str, low: float = LOW, high: float = HIGH, gate=None) -> DataFrame:
    """Unsafe assistance over all windows, and availability over windows of movement (NaN if none)."""
    moves = F.when(F.col("y_true") != REST, assists(low, high, gate).cast("double"))
    return df.groupBy(*by).agg(
        F.avg((assists(low, high, gate) & (F.col("y_true") == REST)).cast("double")).alias("unsafe_assist_rate"),
        F.coalesce(F.avg(moves), F.lit(float("nan"))).alias("assist_availability"),
    )


def evaluate(df: DataFrame, *by: str, low: float = LOW, high: float = HIGH, gate=None) -> DataFrame:
    """All metrics of predictions (y_true, y_pred, confidence) by keys, from one aggregation by keys, class and bin."""
    hit, on = (F.col("y_true") == F.col("y_pred")).cast("long"), assists(low, high, gate).cast("long")
    fine = df.withColumn("bin", bin_of(F.col("confidence"))).groupBy(*by, "y_true", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hits"), F.sum("confidence").alias("conf"), F.sum(on).alias("on"))
    within = lambda c, *more: F.sum(c).over(Window.partitionBy(*(by or [F.lit(1)]), *more))
    fine = fine.withColumns({"class_n": within("n", "y_true"), "class_hits": within("hits", "y_true"), "bin_n": within("n", "bin"), "gap": F.abs(within("hits", "bin") - within("conf", "bin"))})
    n, rest = F.sum("n"), F.col("y_true") == REST
    moves = F.sum(F.when(~rest, F.col("n")))
    return fine.groupBy(*by).agg(
        n.alias("n_test"),
        (F.sum("hits") / n).alias("accuracy"),
        (F.sum(F.col("n") / F.col("class_n") * F.col("class_hits") / F.col("class_n")) / F.count_distinct("y_true")).alias("balanced_accuracy"),
        (F.sum(F.col("n") / F.col("bin_n") * F.col("gap")) / n).alias("ece"),
        (F.coalesce(F.sum(F.when(rest, F.col("on"))), F.lit(0)) / n).alias("unsafe_assist_rate"),
        F.coalesce(F.try_divide(F.sum(F.when(~rest, F.col("on"))), moves), F.lit(float("nan"))).alias("assist_availability"),
    )


def as_row(df: DataFrame, meta: dict[str, str]) -> DataFrame:
    """df with further columns meta_<name>, as text: lists are joined by commas."""
    shown = lambda c: F.array_join(F.col(c).cast("array<string>"), ",") if dict(df.dtypes)[c].startswith("array") else F.col(c).cast("string")
    return df.withColumns({f"meta_{k}": shown(c) for k, c in meta.items()}).drop(*set(meta.values()))


def per_subject(df: DataFrame) -> DataFrame:
    """Of results (subject_id, kind "within" or "cross", balanced_accuracy, ece, ...) one row a subject with both kinds and their differences."""
    names = {"balanced_accuracy": "bal", "ece": "ece", "unsafe_assist_rate": "unsafe", "assist_availability": "avail"}
    one = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c))).alias(f"{kind}_{names[c]}")
    out = df.groupBy("subject_id").agg(*(one(k, c) for c in names for k in ("within", "cross")))
    ratio = F.when(F.col("within_ece") > 0, F.col("cross_ece") / F.col("within_ece")).otherwise(F.lit(float("nan")))
    return out.withColumns({"d_bal": F.col("cross_bal") - F.col("within_bal"), "d_ece": F.col("cross_ece") - F.col("within_ece"), "ece_ratio": ratio})


STUDIED = ("within_bal", "cross_bal", "d_bal", "within_ece", "cross_ece", "d_ece", "ece_ratio", "within_unsafe", "cross_unsafe", "within_avail", "cross_avail")


def across_subjects(subjects: DataFrame, *by: str) -> DataFrame:
    """n_subjects, and mean and population deviation of the finite values of each column of STUDIED."""
    from pulseframe.sources.signals import finite

    aggs = [F.count(F.lit(1)).alias("n_subjects")]
    for c in STUDIED:
        v = F.when(finite(F.col(c)), F.col(c))
        aggs += [F.avg(v).alias(f"{c}_mean"), F.stddev_pop(v).alias(f"{c}_sd")]
    return subjects.groupBy(*by).agg(*aggs)


def central_test(subjects: DataFrame, *by: str) -> DataFrame:
    """Calibration against performance: relative loss of accuracy, and how far calibration errors grow. One row a subject comes in."""
    from pulseframe.sources.signals import finite

    drop, ratio = F.when(F.col("within_bal") > 0, F.col("d_bal") / F.col("within_bal")), F.when(finite(F.col("ece_ratio")), F.col("ece_ratio"))
    return subjects.groupBy(*by).agg(
        F.avg(drop).alias("drop_mean"), F.stddev_pop(drop).alias("drop_sd"), F.avg(ratio).alias("ratio_mean"), F.percentile(ratio, F.lit(0.5)).alias("ratio_median"),
        F.count(ratio).alias("n_ratios"), F.count_if(ratio > 1.0).alias("worse"), F.count_if(ratio >= 1.5).alias("much_worse"),
    )


def benign_against_degraded(sessions: DataFrame, degraded: Column, columns: list[str]) -> DataFrame:
    """Mean and most of the columns by whether a session is degraded."""
    return sessions.groupBy(degraded.alias("degraded")).agg(*(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("max", F.max))))


def sweep(df: DataFrame, *by: str) -> DataFrame:
    """Unsafe rate and availability of hard gates at 0.50, 0.55, ... 0.95."""
    taus = df.sparkSession.createDataFrame([(round(0.5 + 0.05 * k, 2),) for k in range(10)], "tau double")
    on = (F.col("confidence") >= F.col("tau")) & (F.col("y_pred") != REST)
    return df.crossJoin(F.broadcast(taus)).groupBy(*by, "tau").agg(
        F.avg((on & (F.col("y_true") == REST)).cast("double")).alias("unsafe"), F.avg(F.when(F.col("y_true") != REST, on.cast("double"))).alias("availability")
    )


def first_safe_tau(curve: DataFrame, limit: float = 0.01) -> DataFrame:
    """The least tau with an unsafe rate within the limit, else 0.5."""
    return curve.agg(F.coalesce(F.min(F.when(F.col("unsafe") <= limit, F.col("tau"))), F.lit(0.5)).alias("tau"))


def summarize(df: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """n_splits, and mean, population deviation, least and most of the finite values; NaN where there are none."""
    from pulseframe.sources.signals import finite

    nan, aggs = F.lit(float("nan")), [F.count(F.lit(1)).alias("n_splits")]
    for c in columns:
        v = F.when(finite(F.col(c)), F.col(c))
        aggs += [F.coalesce(f(v), nan).alias(f"{c}_{n}") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    return df.groupBy(*by).agg(*aggs)
