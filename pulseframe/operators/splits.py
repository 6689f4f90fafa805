"""Train and test roles of windows under leakage-safe protocols, as long assignment tables.

Rows need subject_id, session_id, seq (order in time), label and repetition. The result
has protocol, split, the window's keys and role; windows in neither role are the guard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pulseframe.sources.signals import KEYS

ID = [*KEYS, "seq"]
MOST_SUBJECTS = 10_000


def recording() -> WindowSpec:
    return Window.partitionBy(*KEYS)


def _assigned(df: DataFrame, protocol: str, split, role) -> DataFrame:
    out = df.select(F.lit(protocol).alias("protocol"), split.alias("split"), *ID, "label", "repetition", role.alias("role"))
    return out.filter(F.col("role").isNotNull())


def _both_sides(assigned: DataFrame) -> DataFrame:
    """Splits with a train and a test side only."""
    w = Window.partitionBy("protocol", "split")
    sides = assigned.withColumn("_tr", F.count_if(F.col("role") == "train").over(w)).withColumn("_te", F.count_if(F.col("role") == "test").over(w))
    return sides.filter("_tr > 0 AND _te > 0").drop("_tr", "_te")


def within_time(df: DataFrame, share: float = 0.7, guard: int = 3) -> DataFrame:
    """Per recording: windows ahead of the cut, less the guard, train; those from the cut on test."""
    pos, n = F.row_number().over(recording().orderBy("seq")) - 1, F.count(F.lit(1)).over(recording())
    df = df.withColumns({"_pos": pos, "_cut": (n * F.lit(share)).cast("long")})
    role = F.when(F.col("_pos") < F.greatest(F.lit(0), F.col("_cut") - guard), "train").when(F.col("_pos") >= F.col("_cut"), "test")
    return _both_sides(_assigned(df, "within-session", F.concat_ws("/", F.lit("within"), *KEYS), role))


def within_repetition(df: DataFrame, share: float = 0.7) -> DataFrame:
    """Per recording: earlier whole repetitions train, later ones test; repetition 0 is cut in time. No guard."""
    by_rep = Window.partitionBy(*KEYS, F.col("repetition") > 0)
    df = df.withColumns(
        {
            "_rank": F.dense_rank().over(by_rep.orderBy("repetition")),
            "_k": F.size(F.collect_set(F.when(F.col("repetition") > 0, F.col("repetition"))).over(recording())),
            "_pos": F.row_number().over(by_rep.orderBy("seq")) - 1,
            "_n": F.count(F.lit(1)).over(by_rep),
        }
    )
    cut = F.greatest(F.lit(1), (F.col("_k") * F.lit(share)).cast("int"))
    trains = F.when(F.col("repetition") > 0, F.col("_rank") <= cut).otherwise(F.col("_pos") < (F.col("_n") * F.lit(share)).cast("long"))
    moved = df.filter("_k >= 2")
    moved = moved.withColumn("_later", F.count_if((F.col("repetition") > 0) & ~trains).over(recording())).filter("_later > 0")
    return _both_sides(_assigned(moved, "within-session", F.concat_ws("/", F.lit("within"), *KEYS), F.when(trains, "train").otherwise("test")))


def cross_session(df: DataFrame, first: int = 1) -> DataFrame:
    """Per subject: the first sessions train; each later one is the test side of a split of its own."""
    rank = F.dense_rank().over(Window.partitionBy("subject_id").orderBy("session_id"))
    ranked = df.withColumn("_rank", rank)
    tests = ranked.filter(F.col("_rank") > first).select("subject_id", F.col("session_id").alias("_test"), (F.col("_rank") - first).alias("sessions_elapsed")).distinct()
    name = F.concat_ws("/", F.lit("cross-session"), "subject_id", "_test")
    train = ranked.filter(F.col("_rank") <= first).join(tests, "subject_id")
    test = ranked.filter(F.col("_rank") > first).withColumn("_test", F.col("session_id"))
    side = lambda d, role: _assigned(d, "cross-session", name, F.lit(role))
    return side(train, "train").unionByName(side(test, "test"))


def cross_session_sides(df: DataFrame, first: int = 1) -> tuple[DataFrame, DataFrame]:
    """The sides of cross_session without repeats: all splits of a subject train on the same rows, which come once;
    test rows carry the name of their split. Models are then fitted a subject, not a split."""
    ranked = df.withColumn("_rank", F.dense_rank().over(Window.partitionBy("subject_id").orderBy("session_id")))
    name = F.concat_ws("/", F.lit("cross-session"), *KEYS)
    return ranked.filter(F.col("_rank") <= first).drop("_rank"), ranked.filter(F.col("_rank") > first).drop("_rank").withColumn("split", name)


def cross_subject(df: DataFrame) -> DataFrame:
    """Leave one subject out: windows times subjects rows, so there may be MOST_SUBJECTS subjects at most."""
    held = df.select(F.col("subject_id").alias("_out")).distinct()
    if (n := held.limit(MOST_SUBJECTS + 1).count()) > MOST_SUBJECTS:
        raise ValueError(f"{n} or more subjects: each is left out once, with all windows on one of the sides")
    pairs = df.crossJoin(F.broadcast(held))
    return _assigned(pairs, "cross-subject", F.concat_ws("/", F.lit("cross-subject"), "_out"), F.when(F.col("subject_id") == F.col("_out"), "test").otherwise("train"))


#: Rows that may come to the driver to settle where a seeded order is cut.
FETCHED = 10_000


def seeded_order(seed: int | None) -> Column:
    """A text by which windows are in seeded order: a digest of seed and keys, the same under any partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in ID)))


def smallest(df: DataFrame, order: Column, n: int, digits: int = 4) -> str | None:
    """The n-th smallest value of order, hexadecimal text, among the rows of df (None: n is 0), without sorting them.

    Rows are counted by leading digits, then by further ones inside the group of the cut, until few
    rows are left in it; these alone are fetched. Groups are at most 16 ** digits.
    """
    if n <= 0:
        return None
    values, prefix = df.select(order.alias("v")), ""
    while True:
        inside = values.filter(F.col("v").startswith(prefix)) if prefix else values
        groups = sorted(tuple(r) for r in inside.groupBy(F.substring("v", 1, len(prefix) + digits).alias("g")).count().collect())
        for group, count in groups:
            if n <= count:
                break
            n -= count
        if count <= FETCHED or len(group) == len(prefix):
            return sorted(r.v for r in values.filter(F.col("v").startswith(group)).limit(FETCHED).collect())[min(n, FETCHED) - 1]
        prefix = group


def random_shuffle(df: DataFrame, share: float = 0.3, seed: int = 0) -> DataFrame:
    """Exactly trunc(n * (1 - share)) windows, the first in seeded order, train; the others test. Neighbours leak into the other side, as is the point."""
    order = seeded_order(seed)
    cut = smallest(df, order, int(df.count() * (1.0 - share)))
    return _assigned(df, "random-shuffle", F.lit("random-shuffle"), F.when(order <= F.lit(cut), "train").otherwise("test"))


def calibrate_class(assigned: DataFrame, n: int = 2) -> DataFrame:
    """Move the earliest n test windows of each class to the training side."""
    order = Window.partitionBy("protocol", "split", "role", "label").orderBy(*ID)
    moved = (F.col("role") == "test") & (F.row_number().over(order) <= n)
    return assigned.withColumn("role", F.when(moved, "train").otherwise(F.col("role"))).withColumn("split", F.concat("split", F.lit(f"+cal{n}")))


def calibrate_repetitions(assigned: DataFrame, n: int = 1) -> DataFrame:
    """Move the first n repetitions of the test side to the training side; rest stays."""
    order = Window.partitionBy("protocol", "split", "role", F.col("repetition") > 0).orderBy("repetition")
    moved = (F.col("role") == "test") & (F.col("repetition") > 0) & (F.dense_rank().over(order) <= n)
    return assigned.withColumn("role", F.when(moved, "train").otherwise(F.col("role"))).withColumn("split", F.concat("split", F.lit(f"+cal{n}rep")))


def three_way(df: DataFrame, fit: int = 2000, calibrate: int = 2000, test: int = 500, seed: int | None = None) -> DataFrame:
    """Per recording: the first windows fit, the next calibrate, the next test; with a seed in shuffled order (by hash) instead of time."""
    u = seeded_order(seed)
    pos = F.row_number().over(recording().orderBy("seq" if seed is None else u)) - 1
    role = F.when(F.col("_pos") < fit, "fit").when(F.col("_pos") < fit + calibrate, "calibrate").when(F.col("_pos") < fit + calibrate + test, "test")
    name = "three-way" if seed is None else "three-way-shuffled"
    return _assigned(df.withColumn("_pos", pos), name, F.concat_ws("/", F.lit(name), *KEYS), role)


def overlaps(assigned: DataFrame) -> DataFrame:
    """Windows on both sides of a split: none, if the protocol is sound."""
    return assigned.groupBy("protocol", "split", *ID).agg(F.count_distinct("role").alias("roles")).filter("roles > 1")


def capped(df: DataFrame, n: int, *by: str) -> DataFrame:
    """At most n rows a group, evenly spaced in order of seq: positions trunc(k * (rows - 1) / (n - 1))."""
    w = Window.partitionBy(*by)
    pos, rows = F.row_number().over(w.orderBy("seq")) - 1, F.count(F.lit(1)).over(w)
    df = df.withColumns({"_pos": pos, "_rows": rows})
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (k * (F.col("_rows") - 1).cast("double") / (n - 1)).cast("long"))
    return df.filter((F.col("_rows") <= n) | F.array_contains(picks, F.col("_pos").cast("long"))).drop("_pos", "_rows")
