"""Quality classifier by positive-unlabelled learning.

A linear model of text statistics minimises the non-negative unbiased risk
    pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))
from trusted positives and unlabelled text, where pi is the estimated share of
positives in the unlabelled text. The trusted positives are rows with label 1 of the
training fold, the unlabelled text documents without a label; label 0 isn't used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.common import freed, fresh, text_or_empty

#: Positives, and unlabelled rows, on which the model is fitted, at most; those with the least hashes of their ids.
MAX_TRAINING_ROWS = 20_000
FOLDS, HELD_OUT = 3, 1


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _LOWER, _DIGIT = (_table(bytes(range(a, b + 1))) for a, b in ((65, 90), (97, 122), (48, 57)))
_HIGH = np.arange(256) >= 128
_END, _SYMBOL = _table(b".!?"), _table(b"#$%&*+<=>@^_`~{}\\")
FEATURES = (
    "log_bytes", "log_words", "log_lines", "word_length", "upper", "digit", "space", "line_end", "high", "full_stop", "comma", "exclamation",
    "question", "symbol", "pipe", "bracket", "quote", "slash", "colon", "hyphen", "distinct_words", "distinct_lines", "top_word", "line_length",
    "byte_entropy", "bare_words", "short", "dead_end", "repeats",
)


def text_features(text: str) -> list[float]:
    """Statistics of the whole text, in time linear in its length; an empty text has zeros."""
    raw = text.encode()
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = lambda mask: float(counts[mask].sum()) / n
    one = lambda *chars: sum(float(counts[ord(c)]) for c in chars) / n
    words = raw.split()
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_words, n_lines = max(1, len(words)), max(1, len(lines))
    p = counts[counts > 0] / n
    letters = max(1.0, float(counts[_UPPER | _LOWER | _HIGH].sum()))
    distinct_lines = len(set(lines)) / n_lines
    return [
        math.log1p(n), math.log1p(len(words)), math.log1p(len(lines)), n / n_words, float(counts[_UPPER].sum()) / letters, share(_DIGIT), one(" "), one("\n"),
        share(_HIGH), one("."), one(","), one("!"), one("?"), share(_SYMBOL), one("|"), one("(", ")", "[", "]"), one('"', "'"), one("/"), one(":", ";"), one("-"),
        len(seen) / n_words, distinct_lines, max(seen.values(), default=0) / n_words, math.log1p(n / n_lines),
        float(-(p * np.log2(p)).sum()), sum(w.isalpha() for w in seen) / max(1, len(seen)), float(len(words) < 60), float(not counts[_END].any()), 1.0 - distinct_lines if n_lines > 1 else 0.0,
    ]


def with_features(df: DataFrame, text: str = "text", out: str = "features") -> DataFrame:
    """Add the column out: array of doubles as named in FEATURES. A null text counts as empty."""

    @F.arrow_udf("array<double>")
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in freed(batches):
            yield pa.array([text_features(t.as_py() or "") for t in texts], pa.list_(pa.float64()))

    return df.withColumn(out, features(text_or_empty(text)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float


def _design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate([z, np.abs(z)], axis=1)


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.03, decay: float = 1e-4) -> Model:
    """Minimise the non-negative risk with the logistic loss by Adam, over all rows in each step.

    Where the unlabelled part R_u(-) - pi * R_p(-) falls below 0, the step goes up
    its slope instead, as for any estimator kept from overfitting this way.
    """
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    p, u = _design(positive, mean, scale), _design(unlabelled, mean, scale)
    theta = np.zeros(p.shape[1] + 1)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -40, 40)))
    grad = lambda x, g: np.append(x.T @ g, g.sum()) / len(x)
    for t in range(1, steps + 1):
        gp, gu = p @ theta[:-1] + theta[-1], u @ theta[:-1] + theta[-1]
        rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        below = grad(u, sigmoid(gu)) - prior * grad(p, sigmoid(gp))
        g = -below if rest < 0 else below + prior * grad(p, sigmoid(gp) - 1)
        g = g + decay * np.append(theta[:-1], 0)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta = theta - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, theta[:-1], float(theta[-1]), prior)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1, slack: float = 0.01) -> float:
    """The share of positives in the unlabelled rows, from scores that tell positives from unlabelled rows.

    The share of unlabelled rows from some score on, over that of positives, bounds
    the prior for every score; the least such bound, where the scores are as pure as
    they get, estimates it. Scores come from models of the other half of the rows,
    and the allowance for chance keeps the choice off thin tails. It is kept off 0 and 1.
    """
    halves = [(positive[k::2], unlabelled[k::2]) for k in (0, 1)]
    if min(len(x) for half in halves for x in half) < 2:
        return 0.5
    scores: tuple[list, list] = [], []
    for k in (0, 1):
        model = fit_nnpu(*halves[k], 0.5, steps=500)
        for out, x in zip(scores, halves[1 - k]):
            out.append(margins(x, model))
    p, u = (np.sort(np.concatenate(x)) for x in scores)
    at = np.unique(np.concatenate([p, u]))
    share_p, share_u = (1 - np.searchsorted(x, at) / len(x) for x in (p, u))
    chance = math.sqrt(math.log(4 / doubt) / 2) * (1 / math.sqrt(len(p)) + 1 / math.sqrt(len(u)))
    at = np.flatnonzero(share_p > 0)
    best = at[np.argmin((share_u[at] + (1 + slack) * chance) / share_p[at])]
    return float(np.clip(share_u[best] / share_p[best], 0.02, 0.98))


def margins(x: np.ndarray, model: Model) -> np.ndarray:
    return _design(x, model.mean, model.scale) @ model.weight + model.bias


def held_out(id_: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text leaves 1 by 3. A null id isn't held out, and has no label."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def training_ids(df: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> list[tuple]:
    """(id, whether a trusted positive) of the rows to fit on, at most 2 * max_rows: of positives
    and of unlabelled ids those with the least hashes. Only ids and labels are read.

    df has the column id, labels has id and label. A row counts as positive if a label of its id in
    the training fold is 1, as unlabelled if its id has none (null ids are neither). Where
    all ids have labels, those of the training fold stand in as unlabelled.
    """
    known = labels.filter(F.col("label").isNotNull() & F.col("id").isNotNull())
    fold = known.filter(~held_out(F.col("id")))
    ids = df.filter(F.col("id").isNotNull()).select("id")
    least = lambda rows: [r.id for r in rows.distinct().orderBy(F.xxhash64("id"), "id").limit(max_rows).collect()]
    positive = least(ids.join(fold.filter("label = 1").select("id"), "id", "left_semi"))
    unlabelled = least(ids.join(known.select("id"), "id", "left_anti")) or least(ids.join(fold.select("id"), "id", "left_semi"))
    return [(i, True) for i in positive] + [(i, False) for i in unlabelled]


def fit(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label_column: str = "quality", max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """The model. Statistics are computed of the texts that it is fitted on alone, a
    bounded number, and come to the driver. Without a positive or an unlabelled row it says 0.5."""
    spark = df.sparkSession
    docs = df.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    chosen = training_ids(docs, labels.select(F.col(id_column).alias("id"), F.col(label_column).alias("label")), max_rows)
    zero = np.zeros(len(FEATURES))
    if len({positive for _, positive in chosen}) < 2:
        return Model(zero, zero + 1, np.zeros(2 * len(FEATURES)), 0.0, 0.5)
    picked = spark.createDataFrame(chosen, f"id {docs.schema['id'].dataType.simpleString()}, positive boolean")
    # An id that several rows have brings one of them.
    rows = with_features(docs.join(F.broadcast(picked), "id")).groupBy("id", "positive").agg(F.min("features").alias("features")).orderBy(F.xxhash64("id"), "id").collect()
    side = lambda positive: np.array([r["features"] for r in rows if r["positive"] == positive], float)
    positive, unlabelled = side(True), side(False)
    return fit_nnpu(positive, unlabelled, estimate_prior(positive, unlabelled))


def score(features: DataFrame, model: Model, column: str = "features", out: str = "score") -> DataFrame:
    """Add the column out: the probability of good quality, from the features alone."""

    @F.arrow_udf("double")
    def scores(rows: pa.Array) -> pa.Array:
        x = rows.flatten().to_numpy().reshape(-1, len(FEATURES))
        return pa.array(1 / (1 + np.exp(-np.clip(margins(x, model), -40, 40))))

    return features.withColumn(out, scores(F.col(column)))


def score_texts(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the column out: the score of the whole text, in one Arrow step. A null text counts as empty."""

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in freed(batches):
            x = np.array([text_features(t.as_py() or "") for t in texts], float).reshape(-1, len(FEATURES))
            yield pa.array(1 / (1 + np.exp(-np.clip(margins(x, model), -40, 40))))

    return df.withColumn(out, scores(text_or_empty(text)))


def classify(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label_column: str = "quality", max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """One row per row of df: id, held_out, score (0 to 1), predicted (1 from 0.5).

    Null texts count as empty; every row gets a score, of its whole text. Equal texts
    get equal scores, so repeated rows and ties do. Null ids are scored and not
    fitted on. Other columns of df, whatever their names, play no part. An empty df
    gives no rows.
    """
    model = fit(df, labels, id_column, text, label_column, max_rows)
    rows = df.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    scored = score_texts(rows, model).select("id", "score")
    return scored.select(F.col("id").alias(id_column), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label_column: str = "quality", max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """The rows of df that the classifier accepts, with their columns under their names; no text is shuffled.

    Nulls, empty texts, repeated rows and an empty df are as in classify.
    """
    name = fresh("_score", df)
    scored = score_texts(df, fit(df, labels, id_column, text, label_column, max_rows), text, name)
    return scored.filter(F.col(name) >= 0.5).drop(name)
