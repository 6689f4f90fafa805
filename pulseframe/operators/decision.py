"""Decision and safety rules of the control loop, as columns and window queries."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.functions import arrays
from pulseframe.operators import qc
from pulseframe.operators.metrics import gate_allows, gate_scale

MAX_TORQUE, ANGLES, MAX_VELOCITY, SLEW = 5.0, (0.0, 2.35), 3.0, 20.0
INERTIA, DAMPING, STOP = 0.05, 0.3, 2.5
MAX_MISSED, MAX_LATENCY, MAX_DESYNC = 3, 0.05, 0.02


def desync(t_a: Column, t_b: Column) -> Column:
    return F.abs(t_a - t_b) > MAX_DESYNC


def fallback(faulted: Column, confidence: Column) -> Column:
    return F.when(faulted, "PASSIVE").when(confidence < 0.4, "LIMITED_ASSIST").otherwise("NONE")


def clamp(torque: Column) -> Column:
    return F.greatest(F.lit(-MAX_TORQUE), F.least(F.lit(MAX_TORQUE), torque))


def enforce(torque: Column, angle: Column, velocity: Column) -> Column:
    inside = angle.between(*ANGLES) & (F.abs(velocity) <= MAX_VELOCITY)
    return F.when(inside, clamp(torque)).otherwise(0.0)


def faults(df: DataFrame, *by: str) -> DataFrame:
    """Add missed (invalid frames in a row) and fault: dropout from the third, else latency above its limit."""
    w = Window.partitionBy(*by).orderBy("i")
    island = F.sum(F.col("valid").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_island", island)
    run = F.sum((~F.col("valid")).cast("int")).over(Window.partitionBy(*by, "_island").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("missed", run)
    return df.withColumn("fault", F.when(F.col("missed") >= MAX_MISSED, "dropout").when(F.col("latency") > MAX_LATENCY, "latency")).drop("_island")


def states(df: DataFrame, *by: str) -> DataFrame:
    """Add state from intent, confidence, safety_ok, emergency and reset, in closed form.

    Since the last reset: EMERGENCY_STOP from the first emergency on, else FALLBACK
    from the first unsafe tick on, else what the tick itself says. A reset's tick
    begins anew.
    """
    w = Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_epoch", F.sum(F.col("reset").cast("int")).over(w))
    e = Window.partitionBy(*by, "_epoch").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    c, intent = F.col("confidence"), F.col("intent")
    now = F.when(intent & (c >= 0.7), "ASSIST").when(intent & (c >= 0.4), "DEGRADED").otherwise("IDLE")
    stopped, fell = F.max(F.col("emergency").cast("int")).over(e) == 1, F.max((~F.col("safety_ok")).cast("int")).over(e) == 1
    return df.withColumn("state", F.when(stopped, "EMERGENCY_STOP").when(fell, "FALLBACK").otherwise(now)).drop("_epoch")


def transitions(df: DataFrame, *by: str) -> DataFrame:
    """Rows where the state changes, with both states; IDLE comes before the first."""
    before = F.lag("state", 1, "IDLE").over(Window.partitionBy(*by).orderBy("i"))
    return df.withColumn("from_state", before).filter(F.col("from_state") != F.col("state")).select(*by, "i", "from_state", F.col("state").alias("to_state"))


def torque(state: Column, confidence: Column, mode: Column) -> Column:
    """Assistance by state; limited assistance applies in any state."""
    helps = state.isin("ASSIST", "DEGRADED") & gate_allows(confidence) & (mode == "NONE")
    return F.when(helps, gate_scale(confidence) * 2.0).when(mode == "LIMITED_ASSIST", 0.4).otherwise(0.0)


def control(frames: DataFrame, lim: dict[str, Column], *by: str, full: float = 0.4, intent: float = 0.15) -> DataFrame:
    """Frames (by, i, x, valid, latency) through the loop up to the torque that is asked for.

    The quality gate and the frame's own flag make it valid or not; missed and late
    frames make faults, and these make the loop unsafe. Confidence is the rms over full, 1 at
    most; intent is an rms above its limit. Nothing resets the state machine unless a column reset does.
    """
    rms, m = arrays.rms(F.col("x")), arrays.mean(F.col("x"))
    std = F.sqrt(arrays.mean(F.transform("x", lambda v: (v - m) * (v - m))))
    reason = qc.gate(std, qc.saturated_fraction(F.col("x"), lim["saturation_limit"]), lim)
    df = frames.withColumns({"rms": rms, "quality": reason, "valid": F.col("valid") & reason.isNull()})
    df = faults(df, *by).withColumns({"confidence": F.least(F.lit(1.0), F.col("rms") / full), "intent": F.col("rms") > intent, "safety_ok": F.col("fault").isNull()})
    df = df.withColumns({c: F.lit(False) for c in ("emergency", "reset") if c not in df.columns})
    df = states(df, *by).withColumn("mode", fallback(~F.col("safety_ok"), F.col("confidence")))
    return df.withColumn("torque", torque(F.col("state"), F.col("confidence"), F.col("mode")))


def events(df: DataFrame, *by: str, rate: float = 20.0) -> DataFrame:
    """The log of a loop: state transitions and safety events, as (by, timestamp, kind, data)."""
    at = (F.col("i") / F.lit(rate)).alias("timestamp")
    moved = transitions(df, *by).select(*by, at, F.lit("state_transition").alias("kind"), F.create_map(F.lit("from"), "from_state", F.lit("to"), "to_state").alias("data"))
    unsafe = df.filter(F.col("fault").isNotNull()).select(*by, at, F.lit("safety_event").alias("kind"), F.create_map(F.lit("reason"), "fault").alias("data"))
    return moved.unionByName(unsafe)


def plant_tick(torque: float, applied: float, angle: float, velocity: float, dt: float) -> tuple[float, float, float]:
    """Limits, then the actuator's slew, then the elbow: velocity first, damped, still at the stops."""
    inside = ANGLES[0] <= angle <= ANGLES[1] and abs(velocity) <= MAX_VELOCITY
    wanted = max(-MAX_TORQUE, min(MAX_TORQUE, torque)) if inside else 0.0
    applied = max(-MAX_TORQUE, min(MAX_TORQUE, applied + max(-SLEW * dt, min(SLEW * dt, wanted - applied))))
    velocity = velocity + (applied - DAMPING * velocity) / INERTIA * dt
    angle = angle + velocity * dt
    if abs(angle) > STOP:
        return applied, max(-STOP, min(STOP, angle)), 0.0
    return applied, angle, velocity


def plant(df: DataFrame, *by: str, dt: float = 0.05) -> DataFrame:
    """Torques in order of i through limits, actuator and elbow: applied, angle and velocity a tick.

    What a tick may apply depends on where the last one left the elbow, so a run is
    one fold, linear in its ticks. Runs come sorted, a batch at a time, and the fold
    carries only its state from one batch to the next, so a run may have any length.
    """
    schema = df.select(*by, "i").schema
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, state = None, (0.0, 0.0, 0.0)
        for batch in batches:
            out = []
            keys = zip(*(batch.column(k).to_pylist() for k in range(len(by)))) if by else repeat(())
            for key, t in zip(keys, batch.column(len(by) + 1).to_pylist()):
                if key != run:
                    run, state = key, (0.0, 0.0, 0.0)
                state = plant_tick(math.nan if t is None else t, *state, dt)
                out.append(state)
            done = [pa.array([o[k] for o in out], pa.float64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by) + 1], *done], [*by, "i", "applied", "angle", "velocity"])

    rows = df.select(*by, F.col("i").cast("long").alias("i"), F.col("torque").cast("double").alias("torque"))
    rows = (rows.repartition(*by) if by else rows.repartition(1)).sortWithinPartitions(*by, "i")
    return rows.mapInArrow(fold, types.rsplit("`i` ", 1)[0] + "`i` long, applied double, angle double, velocity double")
