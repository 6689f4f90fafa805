"""The control loop's state machine and missed-frame counter as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulseframe.operators.decision import MAX_LATENCY, MAX_MISSED

TICKS = "run_id string, i long, valid boolean, latency double, intent boolean, confidence double, safety_ok boolean, emergency boolean, reset boolean"
OUTPUT = "run_id string, i long, missed int, fault string, state string"


def step(state: str, missed: int, row) -> tuple[str, int, str | None]:
    """One tick: the next state, the invalid frames in a row, and the fault."""
    missed = 0 if row.valid else missed + 1
    fault = "dropout" if missed >= MAX_MISSED else "latency" if row.latency > MAX_LATENCY else None
    if row.reset:
        state = "IDLE"
    if row.emergency or state == "EMERGENCY_STOP":
        return "EMERGENCY_STOP", missed, fault
    if state == "FALLBACK" or fault or not row.safety_ok:
        return "FALLBACK", missed, fault
    if row.intent and row.confidence >= 0.4:
        return "ASSIST" if row.confidence >= 0.7 else "DEGRADED", missed, fault
    return "IDLE", missed, fault


def run_loop(frames: DataFrame) -> DataFrame:
    """A stream of ticks (run_id, i, valid, latency, intent, confidence, safety_ok, emergency,
    reset) with their states. Ticks of a run are taken in order of i within a trigger;
    those of later triggers follow."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, missed = state.get if state.exists else ("IDLE", 0)
        rows = pd.concat(batches).sort_values("i")
        out = []
        for row in rows.itertuples():
            name, missed, fault = step(name, missed, row)
            out.append((key[0], row.i, missed, fault, name))
        state.update((name, missed))
        yield pd.DataFrame(out, columns=["run_id", "i", "missed", "fault", "state"])

    return frames.groupBy("run_id").applyInPandasWithState(update, OUTPUT, "name string, missed int", "append", GroupStateTimeout.NoTimeout)


def replay(spark: SparkSession, path: str, schema: str = TICKS) -> DataFrame:
    """Recorded frames as a stream that ends with its files."""
    return spark.readStream.schema(schema).parquet(path)


def to_memory(df: DataFrame, name: str) -> StreamingQuery:
    """Append a stream to the in-memory table of that name until its input ends."""
    return df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
