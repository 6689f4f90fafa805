"""The plant's fold takes a run of any length a batch at a time."""

import random

from pulseframe.operators import decision


def test_runs_go_on_from_batch_to_batch(spark):
    rng = random.Random(3)
    ticks = [(r, i, rng.uniform(-6, 6)) for r in ("a", "b", None) for i in range(200)]
    want = {}
    for r in ("a", "b", None):
        state = (0.0, 0.0, 0.0)
        for _, i, t in filter(lambda x: x[0] == r, ticks):
            want[r, i] = state = decision.plant_tick(t, *state, 0.05)
    rng.shuffle(ticks)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = decision.plant(spark.createDataFrame(ticks, "run string, i long, torque double"), "run")
        assert {(x.run, x.i): (x.applied, x.angle, x.velocity) for x in out.collect()} == want
        plan = out._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan  # no run is gathered whole
