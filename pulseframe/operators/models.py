"""Classifiers and one-class distances, fitted from distributed moments and solved where they are small."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from pulseframe.operators import metrics
from pulseframe.operators.quantiles import exact_quantiles
from pulseframe.streaming.threshold import Trailing

#: Share of the largest eigenvalue, of scaled covariances, below which a direction counts as one without variance.
RANK_CUT = 1e-10
#: Share of a mean by which a constant column may seem to vary.
ROUNDING = 1e-13
#: Models that may be fitted side by side by iteration: a small matrix of each comes to the driver.
MOST_MODELS = 10_000


def moments(df: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """n, means and sample covariances of all pairs, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in columns), *(F.covar_samp(a, b).alias(f"cov_{a}_{b}") for a, b in pairs))


def _matrix(row, columns: list[str]) -> np.ndarray:
    c = np.zeros((len(columns),) * 2)
    for i, a in enumerate(columns):
        for j, b in enumerate(columns[i:], i):
            c[i, j] = c[j, i] = row[f"cov_{a}_{b}"]
    return c


def pooled_inverse(pooled: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Inverse of a covariance on the directions that vary; the others have no weight.

    Variances are scaled to 1 first, so the cut doesn't depend on the units: a constant or repeated
    column takes away a direction, small amplitudes don't. A deviation that rounding of the classes' means
    (rows of means) can make is none.
    """
    scale = np.sqrt(np.clip(np.diag(pooled), 0, None))
    varies = scale > ROUNDING * np.abs(means).max(axis=0)
    scale = np.where(varies, 1 / np.where(varies, scale, 1), 0)
    values, vectors = np.linalg.eigh(pooled * np.outer(scale, scale))
    kept = values > RANK_CUT * max(values.max(initial=0.0), 0.0)
    white = vectors[:, kept] / np.sqrt(values[kept])
    return np.outer(scale, scale) * (white @ white.T)


def linear(columns: list[str], weight: np.ndarray, bias: float) -> Column:
    out = F.lit(float(bias))
    for c, w in zip(columns, weight):
        out = out + F.col(c) * float(w)
    return out


@dataclass
class Discriminant:
    """Linear discriminant analysis: one linear score a class."""

    columns: list[str]
    classes: list[int]
    weights: np.ndarray
    biases: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], label: str = "label") -> Discriminant:
        """Class means, empirical priors and the pooled within-class covariance (divided by n - classes)."""
        rows = sorted(moments(df, columns, label).collect(), key=lambda r: r[label])
        n = np.array([r["n"] for r in rows], float)
        means = np.array([[r[f"mean_{c}"] for c in columns] for r in rows])
        pooled = sum((_matrix(r, columns) * (r["n"] - 1) for r in rows if r["n"] > 1), np.zeros((len(columns),) * 2)) / max(1, n.sum() - len(rows))
        weights = means @ pooled_inverse(pooled, means)
        return cls(columns, [r[label] for r in rows], weights, np.log(n / n.sum()) - 0.5 * (weights * means).sum(axis=1))

    def predict(self, df: DataFrame) -> DataFrame:
        """Add y_pred and confidence, the softmax of the predicted class."""
        scores = F.array(*(linear(self.columns, w, b) for w, b in zip(self.weights, self.biases)))
        return predicted(df, softmax(scores), self.classes)


def discriminants(df: DataFrame, columns: list[str], *by: str, label: str = "label") -> DataFrame:
    """A discriminant for each key, from one aggregation of moments by key and class: by, n_train, classes,
    weights and biases. What is solved in a task are the moments of one key, a row a class. Directions
    without variance have no weight (see pooled_inverse); every key has a discriminant."""
    keys = df.select(*by).schema
    out = T.StructType([*keys.fields, T.StructField("n_train", T.LongType()), T.StructField("classes", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("biases", T.ArrayType(T.DoubleType()))])

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(label)
        n = rows["n"].to_numpy(float)
        means = rows[[f"mean_{c}" for c in columns]].to_numpy(float)
        pooled = np.zeros((len(columns),) * 2)
        for _, r in rows[rows["n"] > 1].iterrows():
            pooled += _matrix(r, columns) * (r["n"] - 1) / max(1, n.sum() - len(rows))
        weights = means @ pooled_inverse(pooled, means)
        biases = np.log(n / n.sum()) - 0.5 * (weights * means).sum(axis=1)
        return pd.DataFrame({**{k: [rows[k].iloc[0]] for k in by}, "n_train": [int(n.sum())], "classes": [rows[label].astype(int).tolist()], "weights": [weights.tolist()], "biases": [biases.tolist()]})

    return moments(df, columns, *by, label).groupBy(*by).applyInPandas(solve, out)


def predict_by(df: DataFrame, fitted: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """Add n_train, y_pred and confidence by the linear scores of the row's key; as many rows come out as went in, and a key without a model is an error."""
    x = F.array(*(F.col(c).cast("double") for c in columns))
    dot = lambda w: F.aggregate(F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    scored = df.join(fitted, list(by), "left").withColumn("_p", softmax(F.zip_with("weights", "biases", lambda w, b: dot(w) + b)))
    best = F.array_max("_p")
    predicted_class = F.when(F.col("weights").isNull(), F.raise_error(F.concat_ws("/", F.lit("no model for"), *(F.col(k).cast("string") for k in by)))).otherwise(F.element_at("classes", F.array_position("_p", best).cast("int")))
    return scored.withColumns({"y_pred": predicted_class.cast("int"), "confidence": best}).drop("_p", "classes", "weights", "biases")


def logistic_sums(x: np.ndarray, y: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Loss, gradient and Hessian of a softmax regression at theta (classes by features, the last of them 1), one after the other."""
    scores = x @ theta.T
    top = scores.max(axis=1, keepdims=True)
    e = np.exp(scores - top)
    p = e / e.sum(axis=1, keepdims=True)
    loss = (top[:, 0] + np.log(e.sum(axis=1)) - scores[np.arange(len(y)), y]).sum()
    gradient = (p - np.eye(len(theta))[y]).T @ x
    hessian = np.einsum("nab,ni,nj->aibj", p[:, :, None] * np.eye(len(theta)) - p[:, :, None] * p[:, None, :], x, x)
    return np.concatenate([[loss], gradient.ravel(), hessian.ravel()])


def logistic_by(train: DataFrame, columns: list[str], *by: str, label: str = "label", c: float = 1.0, most: int = 100, tolerance: float = 1e-9) -> DataFrame:
    """L2-penalised logistic regressions (inverse strength c, free intercepts) of all keys side by side, by Newton's method:
    by, n_train, classes, weights and biases, as discriminants() gives them, for predict_by.

    An iteration is one pass over all training rows, whatever the number of keys: tasks sum loss, gradient and
    Hessian a key, the sums of keys are added in Spark, and steps are solved where they are small. A step that
    raises the loss is halved. Keys whose step falls below tolerance drop out. Two classes have one weight vector, the second's;
    a key with one class predicts it. There may be MOST_MODELS keys. Rows with a null or NaN feature or label are an error.
    """
    spark = train.sparkSession
    bad = F.col(label).isNull()
    for k in columns:
        bad = bad | F.col(k).isNull() | F.isnan(F.col(k).cast("double"))
    rows = train.select(*by, F.when(bad, F.raise_error(F.lit("a training row without a feature or label"))).otherwise(F.col(label)).cast("int").alias("_y"), *(F.col(k).cast("double").alias(k) for k in columns)).persist(StorageLevel.DISK_ONLY)
    try:
        counted = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("_y")).alias("classes")).limit(MOST_MODELS + 1).collect()
        if len(counted) > MOST_MODELS:
            raise ValueError(f"more than {MOST_MODELS} models")
        d, fits = len(columns) + 1, {}
        for r in counted:
            free = len(r.classes) - 1 if len(r.classes) <= 2 else len(r.classes)
            fits[tuple(r[k] for k in by)] = {"n": r.n, "classes": list(r.classes), "free": free, "at": np.zeros((free, d)), "last": None, "loss": math.inf, "done": free == 0}

        def full(fit: dict) -> np.ndarray:
            """All classes' weights: of two classes the first has none."""
            return np.vstack([np.zeros((len(fit["classes"]) - fit["free"], d)), fit["at"]])

        for _ in range(most):
            todo = {k: (full(f), f["classes"]) for k, f in fits.items() if not f["done"]}
            if not todo:
                break

            def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                totals: dict = {}
                for frame in frames:
                    for key, part in frame.groupby(list(by), dropna=False) if by else [((), frame)]:
                        key = key if isinstance(key, tuple) else (key,)
                        if key in todo:
                            theta, classes = todo[key]
                            x = np.column_stack([part[columns].to_numpy(float), np.ones(len(part))])
                            for at in range(0, len(x), 4096):
                                more = logistic_sums(x[at : at + 4096], np.searchsorted(classes, part["_y"].to_numpy()[at : at + 4096]), theta)
                                totals[key] = totals[key] + more if key in totals else more
                if totals:
                    yield pd.DataFrame({**{k: [key[i] for key in totals] for i, k in enumerate(by)}, "v": [v.tolist() for v in totals.values()]})

            schema = T.StructType([*rows.select(*by).schema.fields, T.StructField("v", T.ArrayType(T.DoubleType()))])
            added = rows.mapInPandas(sums, schema).select(*by, F.posexplode("v").alias("pos", "v")).groupBy(*by, "pos").agg(F.sum("v").alias("v"))
            for r in added.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda e: e["v"]).alias("v")).collect():
                newton_step(fits[tuple(r[k] for k in by)], np.array(r.v), d, c, tolerance)
    finally:
        rows.unpersist()
    out = T.StructType([*train.select(*by).schema.fields, T.StructField("n_train", T.LongType()), T.StructField("classes", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("biases", T.ArrayType(T.DoubleType()))])
    return spark.createDataFrame([(*k, f["n"], f["classes"], full(f)[:, :-1].tolist(), full(f)[:, -1].tolist()) for k, f in fits.items()], out)


def newton_step(fit: dict, sums: np.ndarray, d: int, c: float, tolerance: float) -> None:
    """Take sums at fit["at"] and go on: back half a step if the loss has grown, else by Newton."""
    k, free = len(fit["classes"]), fit["free"]
    at, penalty = fit["at"], np.tile(np.append(np.ones(d - 1), 0.0), (free, 1)) / c
    loss = sums[0] + 0.5 * (penalty * at**2).sum()
    if loss > fit["loss"] * (1 + 1e-12) + 1e-12:
        fit["at"] = (fit["last"] + at) / 2
        fit["done"] = np.abs(fit["at"] - fit["last"]).max() < tolerance
        return
    gradient = sums[1 : 1 + k * d].reshape(k, d)[k - free :] + penalty * at
    hessian = sums[1 + k * d :].reshape(k, d, k, d)[k - free :, :, k - free :, :].reshape(free * d, free * d) + np.diag(penalty.ravel())
    step = np.linalg.lstsq(hessian, gradient.ravel(), rcond=1e-13)[0].reshape(free, d)
    fit |= {"last": at, "loss": loss, "at": at - step, "done": np.abs(step).max() < tolerance * max(1.0, np.abs(at).max())}


def evaluate_splits(train: DataFrame, test: DataFrame, columns: list[str], fit_by, *by: str, label: str = "label") -> DataFrame:
    """Metrics a split for models that are fitted side by side, such as discriminants and logistic_by.

    train has keys, label and columns; test also has split, and any number of its splits may share a key and so a model.
    """
    scored = predict_by(test.withColumn("y_true", F.col(label)), fit_by(train, columns, *by, label=label), columns, *by)
    return metrics.evaluate(scored, "split", "n_train")


def predict_any(train: DataFrame, test: DataFrame, columns: list[str], fit_predict, *by: str, label: str = "label") -> DataFrame:
    """Add y_pred and confidence to test by any model: fit_predict(x_train, y_train, x_test) of numpy arrays returns
    predictions and the probabilities of the predicted classes.

    All keys in one plan; the training and test rows of one key meet in a task and must fit its memory. Test rows
    of a key without training rows are an error, and so is a model that returns another number of rows.
    """
    out = T.StructType([*test.schema.fields, T.StructField("y_pred", T.IntegerType()), T.StructField("confidence", T.DoubleType())])

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(right):
            return pd.DataFrame({f.name: [] for f in out})
        if not len(left):
            raise ValueError(f"no training rows for {[right[k].iloc[0] for k in by]}")
        got, sure = fit_predict(left[[f"_x{k}" for k in range(len(columns))]].to_numpy(float), left["_y"].to_numpy(), right[columns].to_numpy(float))
        if len(got) != len(right):
            raise ValueError(f"{len(got)} predictions for {len(right)} rows")
        return right.assign(y_pred=np.asarray(got).astype("int32"), confidence=np.asarray(sure, float))

    left = train.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(by)), F.col(label).alias("_y"), *(F.col(c).alias(f"_x{i}") for i, c in enumerate(columns)))
    return left.groupBy(*(f"_k{i}" for i in range(len(by)))).cogroup(test.groupBy(*by)).applyInPandas(run, out)


def lda(train: DataFrame, columns: list[str], label: str = "label"):
    """The discriminant as a fit_predict."""
    return Discriminant.fit(train, columns, label).predict


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def predicted(df: DataFrame, probabilities: Column, classes: list[int]) -> DataFrame:
    """The class of the greatest probability, the first of equals, and that probability."""
    df = df.withColumn("_p", probabilities)
    best = F.array_max("_p")
    return df.withColumns({"y_pred": F.element_at(F.array(*map(F.lit, classes)), F.array_position("_p", best).cast("int")), "confidence": best}).drop("_p")


def logistic(train: DataFrame, columns: list[str], label: str = "label", c: float = 1.0):
    """One penalised logistic regression as a fit_predict."""
    fitted = logistic_by(train.withColumn("_all", F.lit(0)), columns, "_all", label=label, c=c).drop("n_train")
    return lambda df: predict_by(df.withColumn("_all", F.lit(0)), fitted, columns, "_all").drop("_all")


@dataclass
class OneClass:
    """Mahalanobis distance to the training rows, with a threshold at a quantile of distances."""

    columns: list[str]
    mean: np.ndarray
    inverse: np.ndarray
    threshold: float | None = None

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], contamination: float = 0.025, ridge: float = 1e-6, calibration: DataFrame | None = None) -> OneClass:
        if not 0 < contamination < 1:
            raise ValueError("contamination must lie between 0 and 1")
        row = moments(df, columns).first()
        if row["n"] < 2:
            raise ValueError("two training rows are needed at least")
        model = cls(columns, np.array([row[f"mean_{c}"] for c in columns]), np.linalg.inv(_matrix(row, columns) + ridge * np.eye(len(columns))))
        model.threshold = exact_quantiles(df if calibration is None else calibration, {"t": (model.distance(), 1 - contamination)})["t"]
        return model

    def distance(self) -> Column:
        delta = [F.col(c) - float(m) for c, m in zip(self.columns, self.mean)]
        total = F.lit(0.0)
        for i, a in enumerate(delta):
            for j, b in enumerate(delta):
                total = total + a * b * float(self.inverse[i, j])
        return F.sqrt(total)

    def flag(self) -> Column:
        return self.distance() > self.threshold


def adaptive_threshold(df: DataFrame, distance: str, *by: str, order: str = "seq", contamination: float = 0.025, most: int = 4000, least: int = 200) -> DataFrame:
    """Rows (by, order, distance) with threshold: quantile of the trailing distances of the session, infinite until there are enough.

    Rows come sorted, and a task keeps the last most distances, sorted too, from row to row. A null or NaN
    distance has the threshold of those before it and doesn't count among them.
    """
    q = 1 - contamination

    def trail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, trailing = None, Trailing(most)
        for batch in batches:
            out = []
            for key, d in zip(zip(*(batch.column(k).to_pylist() for k in range(len(by)))), batch.column(len(by) + 1).to_pylist()):
                if key != session:
                    session, trailing = key, Trailing(most)
                if d is not None and d == d:
                    trailing.add(d)
                out.append(trailing.quantile(q) if len(trailing) >= least else float("inf"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "threshold"])

    rows = df.select(*by, order, F.col(distance).cast("double").alias(distance)).repartition(*by).sortWithinPartitions(*by, order)
    return rows.mapInArrow(trail, T.StructType([*rows.schema.fields, T.StructField("threshold", T.DoubleType())]))
