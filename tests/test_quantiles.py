"""Exact quantiles against sorted values, with few and with many passes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.operators import quantiles


@pytest.mark.parametrize("fetched, bins", [(20_000, 1024), (5, 4)])
def test_quantiles_equal_numpy(spark, monkeypatch, fetched, bins):
    monkeypatch.setattr(quantiles, "FETCHED", fetched)
    monkeypatch.setattr(quantiles, "BINS", bins)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.lognormal(0, 3, 300), np.zeros(40), [1e9]])
    data = [(float(v), None if i % 7 else float(i), 2.5) for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "x double, y double, same double").repartition(5)
    asked = {f"x{k}": (F.col("x"), q) for k, q in enumerate((0, 0.001, 0.5, 0.999, 1))} | {"y": (F.col("y"), 0.3), "same": (F.col("same"), 0.5)}
    got = quantiles.exact_quantiles(df, asked)
    want = {n: np.quantile([r[("x", "y", "same").index(n[0] if n != "same" else n)] for r in data if r[1] is not None or n[0] != "y"], q) for n, (_, q) in asked.items()}
    assert got == pytest.approx(want, rel=1e-12)


def test_quantiles_of_nothing_and_of_nan(spark):
    df = spark.createDataFrame([(1.0, None), (math.nan, None)], "x double, y double")
    got = quantiles.exact_quantiles(df, {"least": (F.col("x"), 0.0), "most": (F.col("x"), 1.0), "none": (F.col("y"), 0.5)})
    assert got["least"] == 1.0 and math.isnan(got["most"]) and got["none"] is None
    assert quantiles.exact_quantiles(df.limit(0), {"x": (F.col("x"), 0.5)}) == {"x": None}
