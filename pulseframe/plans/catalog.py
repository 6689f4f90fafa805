"""All registered queries of the signal engine with their oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseframe.functions import arrays
from pulseframe.operators import build, decision, dsp, metrics, models, qc, splits
from pulseframe.operators import windows as win
from pulseframe.operators.quantiles import exact_quantiles
from pulseframe.plans import oracles as o
from pulseframe.sources import loaders, mat, signals, storage
from pulseframe.sources.signals import KEYS
from pulseframe.streaming import loop as control
from pulseframe.streaming import threshold

QUERIES: dict = {}
ORACLES: dict = {}
ID = ["subject_id", "session_id", "seq"]
ROUND = 6


def register(name: str, oracle: str | None = None):
    def wrap(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return wrap


def rounded(df: DataFrame, digits: int = ROUND) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def derived(name: str, base: str, columns: str) -> None:
    """A query with some columns of another, and its oracle likewise."""
    names = [c.strip() for c in columns.split(",")]
    QUERIES[name] = lambda spark, sf_dir, f=QUERIES[base]: f(spark, sf_dir).select(*names)
    ORACLES[name] = f"SELECT {columns} FROM ({ORACLES[base]})"


def r(columns: str, digits: int = ROUND) -> str:
    return ", ".join(f"round({c.strip()}, {digits}) + 0::DOUBLE AS {c.strip()}" for c in columns.split(","))


def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.samples_from_events(spark, sf_dir)


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win.sliding(sample_rows(spark, sf_dir))


def pure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(spark, sf_dir).filter("pure").select(*ID, "label", "repetition")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows(spark, sf_dir).filter("pure")
    return w.select(*ID, (F.col("label") != 0).cast("int").alias("y_true"), (F.col("rms_ch0") > 0.8).cast("int").alias("y_pred"), F.least(F.lit(1.0), F.col("rms_ch0") / 1.5).alias("confidence"))


# Sources and projections

register("src_samples", f"WITH {o.SAMPLES} SELECT subject_id, session_id, sample_idx, label, repetition, {r('ch0, ch1')} FROM smp")(lambda s, d: rounded(sample_rows(s, d)))
derived("proj_channels", "src_samples", "subject_id, session_id, sample_idx, ch1")
register("subjects", f"WITH {o.SAMPLES} SELECT DISTINCT subject_id FROM smp")(lambda s, d: sample_rows(s, d).select("subject_id").distinct())
register("src_db6_load", f"WITH {o.SAMPLES} SELECT subject_id, session_id, sample_idx FROM smp WHERE subject_id IN ('s01', 's03') AND session_id = 'd02'")(
    lambda s, d: loaders.loader("events", s, d).load(["s01", "s03"], ["d02"]).select("subject_id", "session_id", "sample_idx")
)
register("proj_binary_labels", f"WITH {o.WINDOWS} SELECT subject_id, session_id, seq, (label <> 0)::INT AS label FROM win")(lambda s, d: win.binary_labels(windows(s, d)).select(*ID, "label"))


@register(
    "src_db6_index",
    """SELECT path, 's' || lpad(a, 2, '0') AS subject_id, 'd' || lpad(b, 2, '0') || '_t' || lpad(c, 2, '0') AS session_id FROM (
        SELECT 'db/S' || (s_suppkey % 12) || '_D' || (s_nationkey % 5 + 1) || '_t' || (s_suppkey % 2 + 1) || '.mat' AS path, (s_suppkey % 12)::VARCHAR AS a, (s_nationkey % 5 + 1)::VARCHAR AS b, (s_suppkey % 2 + 1)::VARCHAR AS c FROM supplier)""",
)
def src_db6_index(spark, sf_dir):
    part = lambda e: F.expr(e).cast("string")
    paths = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.explode(F.array(F.concat(F.lit("db/S"), part("s_suppkey % 12"), F.lit("_D"), part("s_nationkey % 5 + 1"), F.lit("_t"), part("s_suppkey % 2 + 1"), F.lit(".mat")), F.lit("db/._S1_D1_T1.mat"), F.lit("db/readme.mat"))).alias("path")
    )
    return signals.recording_index(paths)


@register("src_db6_read", f"WITH {o.SAMPLES} SELECT subject_id, session_id || '_t01' AS session_id, sample_idx, label, repetition, {r('ch0, ch1')} FROM smp WHERE subject_id IN ('s01', 's03')")
def src_db6_read(spark, sf_dir):
    """Recordings written as matrix files, one each, and those of two subjects read back; files of others stay closed."""
    root = storage.fresh_path(spark, "recordings")
    name = F.concat(F.lit("S"), F.substring("subject_id", 2, 9), F.lit("_D"), F.substring("session_id", 2, 9), F.lit("_T1"))
    rows = sample_rows(spark, sf_dir).select(name.alias("file"), "sample_idx", "label", "repetition", F.array("ch0", "ch1").alias("ch"))
    mat.write_recordings(rows, root).write.format("noop").mode("overwrite").save()
    read = mat.read_recordings(spark, root, subjects=["s01", "s03"], channels=(0, 1))
    return rounded(read.select(*KEYS, "sample_idx", "label", "repetition", F.col("ch")[0].alias("ch0"), F.col("ch")[1].alias("ch1")))


register("src_frames", "SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, round(unnest(embedding)::DOUBLE, 6) AS value, round((generate_subscripts(embedding, 1) - 1) / 1000.0::DOUBLE, 6) AS timestamp FROM embeddings")(
    lambda s, d: rounded(signals.frames(signals.embedding_windows(s, d))).withColumn("pos", F.col("pos").cast("long"))
)

# Windows and features

FEATURES = ", ".join(f"{f}_{c}" for f in ("rms", "mav", "zcr", "wl", "ssc", "std", "mean", "absmax") for c in ("ch0", "ch1"))
register("win_sliding", f"WITH {o.WINDOWS} SELECT subject_id, session_id, seq, start_idx, label, repetition, pure, {r(FEATURES)} FROM win")(lambda s, d: rounded(windows(s, d).drop("x_ch0", "x_ch1")))
derived("win_last_label", "win_sliding", "subject_id, session_id, seq, label, repetition")
derived("feat_hudgins", "win_sliding", ", ".join([*ID, *(f"{f}_{c}" for f in win.FEATURES for c in win.CHANNELS)]))
for _f in win.FEATURES:
    derived(f"feat_{_f}", "win_sliding", f"subject_id, session_id, seq, {_f}_ch0, {_f}_ch1")
derived("feat_matrix", "feat_hudgins", ", ".join(f"{f}_{c}" for f in win.FEATURES for c in win.CHANNELS))
register("filter_pure", f"WITH {o.WINDOWS} SELECT subject_id, session_id, count(*) AS windows, count(*) FILTER (pure) AS pure FROM win GROUP BY ALL")(
    lambda s, d: windows(s, d).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("windows"), F.count_if("pure").alias("pure"))
)
register("win_build", f"WITH {o.PURE} SELECT subject_id, session_id, seq, label, CASE WHEN (SELECT bool_and(repetition IS NOT NULL) FROM smp) THEN repetition END AS repetition FROM pw")(
    lambda s, d: pure(s, d).crossJoin(F.broadcast(sample_rows(s, d).agg(F.bool_and(F.col("repetition").isNotNull()).alias("all_known")))).select(*ID, "label", F.when(F.col("all_known"), F.col("repetition")).alias("repetition"))
)
register(
    "win_sample_linspace",
    f"WITH {o.WINDOWS} SELECT subject_id, session_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, session_id ORDER BY seq) - 1 AS pos, count(*) OVER (PARTITION BY subject_id, session_id) AS n FROM win)"
    " WHERE n <= 5 OR list_contains(list_transform(range(5), lambda k: trunc(k * (n - 1)::DOUBLE / 4)::BIGINT), pos)",
)(lambda s, d: splits.capped(windows(s, d), 5, *KEYS).select(*ID))


def builds(spark, sf_dir, make):
    """What make gives of several configurations, from samples that need no filter."""
    out = []
    for width, stride, inspected in o.BUILDS:
        config = signals.PreprocessConfig(bandpass_hz=None, notch_hz=None, window_ms=width, stride_ms=stride, qc_kwargs=o.LIMITS, qc_channels=tuple(win.CHANNELS.index(c) for c in inspected))
        out.append(make(sample_rows(spark, sf_dir), config).withColumn("size", F.lit(f"{width}/{stride}")))
    return reduce(DataFrame.unionByName, out)


_BUILT_COLUMNS = ", ".join(f"{f}_{c}" for f in ("rms", "wl", "ssc", "zcr", "std") for c in win.CHANNELS)
register("build_windows", f"WITH {o.BUILT} SELECT size, subject_id, session_id, seq, start_idx, label, repetition, len(x_ch0) AS width, {r(_BUILT_COLUMNS)} FROM built WHERE len(failures) = 0")(
    lambda s, d: rounded(builds(s, d, lambda smp, config: build.build_windows(smp, config, 1000.0)).select("size", *ID, "start_idx", "label", "repetition", F.size("x_ch0").cast("long").alias("width"), *_BUILT_COLUMNS.split(", ")))
)
register("build_judged", f"WITH {o.BUILT} SELECT size, subject_id, session_id, seq, array_to_string(failures, ',') AS failures FROM built")(
    lambda s, d: builds(s, d, lambda smp, config: build.judged_windows(smp, config, 1000.0)).select("size", *ID, F.array_join("failures", ",").alias("failures"))
)
_REASONS = ", ".join(f"count(*) FILTER (list_contains(failures, '{k}')) AS {k}" for k in build.REASONS)
register("build_account", f"WITH {o.BUILT} SELECT size, subject_id, count(*) AS total, count(*) FILTER (len(failures) = 0) AS kept, round(avg((len(failures) > 0)::INT), 6) AS rejection_rate, {_REASONS} FROM built GROUP BY size, subject_id")(
    lambda s, d: rounded(builds(s, d, lambda smp, config: build.account(build.judged_windows(smp, config, 1000.0), "subject_id")).select("size", "subject_id", "total", "kept", "rejection_rate", *(F.coalesce(F.col("rejected_by_reason")[k], F.lit(0)).alias(k) for k in build.REASONS)))
)
_PICKS = "CASE WHEN n <= 7 THEN range(n) ELSE list_distinct(list_transform(range(7), lambda k: CASE WHEN k = 6 THEN n - 1 ELSE trunc(k * ((n - 1) / 6.0::DOUBLE))::BIGINT END)) END"
register(
    "profile_sampled",
    f"WITH {o.WINDOWS}, c AS (SELECT subject_id, session_id, count(*) AS n FROM win GROUP BY ALL), picks AS (SELECT subject_id, session_id, unnest({_PICKS}) AS seq FROM c), p AS (SELECT win.* FROM win JOIN picks USING (subject_id, session_id, seq))"
    f" SELECT subject_id, session_id, seq, 'ch0' AS channel, {r('rms_ch0, mean_ch0, absmax_ch0').replace('AS rms_ch0', 'AS rms').replace('AS mean_ch0', 'AS mean').replace('AS absmax_ch0', 'AS absmax')} FROM p"
    f" UNION ALL SELECT subject_id, session_id, seq, 'ch1', {r('rms_ch1, mean_ch1, absmax_ch1')} FROM p",
)(lambda s, d: rounded(build.sampled_profile(sample_rows(s, d), win.WIDTH, win.STRIDE, most=7)))
_TUMBLING = f"{o.SAMPLES}, {o.LAGGED}, {o.sliding('win', 8, 8)}"
register("win_tumbling", f"WITH {_TUMBLING} SELECT subject_id, session_id, seq, start_idx, {r('rms_ch0, wl_ch1')} FROM win")(lambda s, d: rounded(win.sliding(sample_rows(s, d), stride=win.WIDTH).select(*ID, "start_idx", "rms_ch0", "wl_ch1")))
register("filter_finite", f"WITH {o.SAMPLES} SELECT subject_id, session_id, count(*) AS n, count(*) FILTER (ch1 > 0) AS finite, round(avg(ln(ch1)) FILTER (ch1 > 0), 6) AS mean_log FROM smp GROUP BY ALL")(
    lambda s, d: rounded(
        sample_rows(s, d).withColumn("v", F.when(F.col("ch1") > 0, F.ln("ch1")).when(F.col("ch1") == 0, float("-inf")).otherwise(float("nan"))).groupBy(*KEYS).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(signals.finite(F.col("v"))).alias("finite"), F.avg(F.when(signals.finite(F.col("v")), F.col("v"))).alias("mean_log")
        )
    )
)


@register("preprocess")
def preprocess(spark, sf_dir):
    """Resampled to half the rate, band-passed and notched; no SQL has the filters, tests hold them against whole-recording versions."""
    config = signals.PreprocessConfig(target_sample_rate=500.0, bandpass_hz=(20.0, 200.0))
    return rounded(dsp.preprocess(sample_rows(spark, sf_dir), config, 1000.0, short="nan"))


register("resample_poly")(lambda s, d: rounded(dsp.resample_recordings(sample_rows(s, d), 1000.0, 800.0)))
register("filter_recording")(lambda s, d: rounded(dsp.filter_recordings(sample_rows(s, d), 1000.0, short="nan")))
register(
    "resample_labels",
    f"WITH {o.SAMPLES}, sized AS (SELECT subject_id, session_id, count(*) AS n_old, ceil(count(*) / 2)::BIGINT AS n_new FROM smp GROUP BY ALL), grid AS (SELECT *, unnest(range(n_new)) AS i FROM sized)"
    " SELECT g.subject_id, g.session_id, i, label, repetition FROM grid g JOIN smp ON smp.subject_id = g.subject_id AND smp.session_id = g.session_id AND sample_idx = least(trunc(i * n_old::DOUBLE / n_new)::BIGINT, n_old - 1)",
)(lambda s, d: win.resample_labels(sample_rows(s, d), F.ceil(F.col("n_old") / 2), F.col("n_old")))
register(
    "feat_standardize",
    f"WITH {o.WINDOWS}, st AS (SELECT avg(rms_ch0) AS m, stddev_pop(rms_ch0) AS s FROM win WHERE pure AND subject_id <> 's00') SELECT subject_id, session_id, seq, round((rms_ch0 - m) / s, 6) AS rms_ch0 FROM win, st WHERE pure",
)(lambda s, d: rounded(win.standardize(windows(s, d).filter("pure").select(*ID, "rms_ch0"), ["rms_ch0"], F.col("subject_id") != "s00")))

_E = "SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings"
_RMS = "sqrt(list_avg(list_transform({x}, lambda v: v * v)))"
register(
    "feat_shape",
    f"""WITH e AS ({_E}), m AS (SELECT *, list_avg(x) AS mu, {_RMS.format(x="x")} AS rms FROM e)
        SELECT vec_id, round(list_avg(list_transform(x, lambda v: (v - mu) ** 4)) / list_avg(list_transform(x, lambda v: (v - mu) ** 2)) ** 2, 6) AS kurt,
               round(list_max(list_transform(x, lambda v: abs(v))) / rms, 6) AS crest,
               round(list_max(list_transform(range(10), lambda k: {_RMS.format(x="x[k * 6 + 1 : k * 6 + 6]")})) / rms, 6) AS sw_rms FROM m""",
)(lambda s, d: rounded(signals.embedding_windows(s, d).select("vec_id", arrays.kurtosis(F.col("x")).alias("kurt"), arrays.crest(F.col("x")).alias("crest"), arrays.sub_window_rms(F.col("x")).alias("sw_rms"))))
derived("feat_kurt", "feat_shape", "vec_id, kurt")
derived("feat_crest", "feat_shape", "vec_id, crest")
derived("feat_swrms", "feat_shape", "vec_id, sw_rms")
derived("win_subwindows", "feat_shape", "vec_id, sw_rms")
_DFT = "list_transform(range(33), lambda k: list_sum(list_transform(range(64), lambda i: (x[i + 1] - mu) * cos(2 * pi() * k * i / 64))) ** 2 + list_sum(list_transform(range(64), lambda i: (x[i + 1] - mu) * sin(2 * pi() * k * i / 64))) ** 2)"
register(
    "feat_spectrum",
    f"""WITH e AS ({_E}), p AS (SELECT vec_id, {_DFT} AS p FROM (SELECT *, list_avg(x) AS mu FROM e))
        SELECT vec_id, round(list_sum(list_transform(range(33), lambda k: p[k + 1] * k * 1000 / 64)) / list_sum(p), 6) AS mnf, round(list_sum(list_transform(range(10, 33), lambda k: p[k + 1])) / list_sum(p), 6) AS hfr FROM p""",
)(lambda s, d: rounded(arrays.anomaly_features(signals.embedding_windows(s, d), "x", 1000.0).select("vec_id", "mnf", "hfr")))
register("feat_psd", f"WITH e AS ({_E}), p AS (SELECT vec_id, {_DFT} AS p FROM (SELECT *, list_avg(x) AS mu FROM e)) SELECT vec_id, generate_subscripts(p, 1) - 1 AS k, round(unnest(p), 6) AS power FROM p")(
    lambda s, d: rounded(signals.embedding_windows(s, d).select("vec_id", F.posexplode(arrays.psd("x")).alias("k", "power"))).withColumn("k", F.col("k").cast("long"))
)
_LAG = "list_transform(range(1, 64), lambda i: x[i + 1] - x[i])"
register(
    "feat_anomaly10",
    f"""WITH e AS ({_E}), m AS (SELECT *, list_avg(x) AS mu, {_RMS.format(x="x")} AS rms, {_LAG} AS d FROM e), p AS (SELECT *, {_DFT} AS p FROM m)
        SELECT vec_id, round(rms, 6) AS rms, round(list_avg(list_transform(x, lambda v: abs(v))), 6) AS mav,
               round(len(list_filter(range(1, 64), lambda i: (x[i] < 0) <> (x[i + 1] < 0) AND x[i] <> x[i + 1])) / 63.0::DOUBLE, 6) AS zcr, round(list_sum(list_transform(d, lambda v: abs(v))), 6) AS wl,
               round(len(list_filter(range(1, 63), lambda i: d[i] * d[i + 1] < 0)) / 62.0::DOUBLE, 6) AS ssc,
               round(list_sum(list_transform(range(33), lambda k: p[k + 1] * k * 1000 / 64)) / list_sum(p), 6) AS mnf, round(list_sum(list_transform(range(10, 33), lambda k: p[k + 1])) / list_sum(p), 6) AS hfr,
               round(list_avg(list_transform(x, lambda v: (v - mu) ** 4)) / list_avg(list_transform(x, lambda v: (v - mu) ** 2)) ** 2, 6) AS kurt, round(list_max(list_transform(x, lambda v: abs(v))) / rms, 6) AS crest,
               round(list_max(list_transform(range(10), lambda k: {_RMS.format(x="x[k * 6 + 1 : k * 6 + 6]")})) / rms, 6) AS sw_rms FROM p""",
)(lambda s, d: rounded(arrays.anomaly_features(signals.embedding_windows(s, d), "x", 1000.0).select("vec_id", *arrays.ANOMALY_FEATURES)))
register("feat_batch", f"WITH {o.WINDOWS} SELECT subject_id, session_id, seq, {r('wl_ch0, wl_ch1, rms_ch0, rms_ch1')} FROM win")(
    lambda s, d: rounded(arrays.batch_features(windows(s, d).select(*ID, "x_ch0", "x_ch1"), {"ch0": "x_ch0", "ch1": "x_ch1"}, ("wl", "rms")).drop("x_ch0", "x_ch1"))
)
derived("feat_mnf", "feat_spectrum", "vec_id, mnf")
derived("feat_hfr", "feat_spectrum", "vec_id, hfr")

# Quality


def profile(spark, sf_dir):
    return win.long_by_channel(windows(spark, sf_dir))


def saved_windows(spark, sf_dir) -> DataFrame:
    """The windows with what quality is judged by, computed once: limits follow from all of them before any is checked."""
    columns = [f"{n}_{c}" for n in ("x", "rms", "mav", "std", "mean", "absmax") for c in win.CHANNELS]
    return storage.saved(windows(spark, sf_dir).select(*ID, "label", "repetition", "pure", *columns), "windows")


def tight_limits(w: DataFrame) -> DataFrame:
    t = qc.thresholds(win.long_by_channel(w, names=("rms", "mean", "absmax")), margin=0.9)
    return t.withColumn("saturation_limit", F.col("saturation_limit") / 0.9 * 0.5)


def checked(spark, sf_dir, rows=win.long_by_channel):
    """The pure windows, a row a channel or as rows gives them, with the limits, and these as columns."""
    w = saved_windows(spark, sf_dir)
    t = tight_limits(w)
    return rows(w).filter("pure").crossJoin(F.broadcast(t)), qc.limits(min_clip_run=2, min_zero_run=2, **{c: F.col(c) for c in t.columns})


@register("qc_checks", f"WITH {o.CHECKS} SELECT subject_id, session_id, seq, channel, dropout, dropout_run, saturation, clipping, amplitude_low, amplitude_high, baseline_offset FROM checked")
def qc_checks(spark, sf_dir):
    df, lim = checked(spark, sf_dir)
    return df.select(*ID, "channel", *(c.alias(k) for k, c in qc.reasons(lim).items()))


for _k in ("dropout", "dropout_run", "saturation", "clipping"):
    derived(f"qc_{_k}", "qc_checks", f"subject_id, session_id, seq, channel, {_k}")
derived("qc_amplitude", "qc_checks", "subject_id, session_id, seq, channel, amplitude_low, amplitude_high")
derived("qc_offset", "qc_checks", "subject_id, session_id, seq, channel, baseline_offset")


@register("qc_gate", f"WITH {o.CHECKS} SELECT subject_id, session_id, seq, channel, CASE WHEN dropout THEN 'dropout' WHEN saturation THEN 'saturation' END AS reason FROM checked")
def qc_gate(spark, sf_dir):
    df, lim = checked(spark, sf_dir)
    return df.select(*ID, "channel", qc.gate(F.col("std"), qc.saturated_fraction(F.col("x"), lim["saturation_limit"]), lim).alias("reason"))


@register("qc_longest_run", f"WITH {o.CHECKS} SELECT subject_id, session_id, seq, channel, {o.run('x', 'v > 0')} AS run FROM chan WHERE pure")
def qc_longest_run(spark, sf_dir):
    return profile(spark, sf_dir).filter("pure").select(*ID, "channel", qc.longest_run(F.col("x"), lambda v: v > 0).alias("run"))


@register("qc_report", f"WITH {o.CHECKS} SELECT subject_id, session_id, seq, channel, array_to_string(failures, ',') AS failures, round(std, 6) AS std, round(rms, 6) AS rms, round(mav, 6) AS mav, round(mean, 6) + 0::DOUBLE AS dc_offset FROM failed")
def qc_report(spark, sf_dir):
    out = qc.channel_failures(*checked(spark, sf_dir))
    return rounded(out.select(*ID, "channel", F.array_join("failures", ",").alias("failures"), "std", "rms", "mav", F.col("mean").alias("dc_offset")))


def gated(spark, sf_dir):
    df, lim = checked(spark, sf_dir, lambda w: w)
    return qc.judge(df, list(win.CHANNELS), lim)


register("qc_window_failures", f"WITH {o.CHECKS} SELECT subject_id, session_id, seq, array_to_string(failures, ',') AS failures, valid FROM qc")(lambda s, d: gated(s, d).select(*ID, F.array_join("failures", ",").alias("failures"), "valid"))
register("filter_qc", f"WITH {o.CHECKS} SELECT subject_id, session_id, seq FROM qc WHERE valid")(lambda s, d: gated(s, d).filter("valid").select(*ID))
_ACC = "count(*) AS total, count(*) FILTER (valid) AS kept, count(*) FILTER (NOT valid) AS rejected, round(count(*) FILTER (NOT valid) / count(*)::DOUBLE, 6) AS rejection_rate"
register("qc_account", f"WITH {o.CHECKS} SELECT subject_id, {_ACC} FROM qc GROUP BY subject_id")(lambda s, d: rounded(qc.account(gated(s, d), "subject_id")))
register("qc_merge", f"WITH {o.CHECKS} SELECT reason, count(*) AS n FROM (SELECT unnest(failures) AS reason FROM qc) GROUP BY reason")(lambda s, d: qc.account_reasons(gated(s, d)))
register("qc_by_session", f"WITH {o.CHECKS} SELECT subject_id, session_id, {_ACC} FROM qc GROUP BY ROLLUP (subject_id, session_id)")(
    lambda s, d: rounded(
        gated(s, d).rollup(*KEYS).agg(F.count(F.lit(1)).alias("total"), F.count_if("valid").alias("kept")).withColumn("rejected", F.col("total") - F.col("kept")).withColumn("rejection_rate", qc.rate(F.col("rejected"), F.col("total")))
    )
)
register("pred_qc_channels", f"WITH {o.CHECKS} SELECT subject_id, session_id, seq, array_to_string(failures, ',') AS failures, len(failures) = 0 AS valid FROM failed WHERE channel = 'ch1'")(
    lambda s, d: (lambda df, lim: qc.window_failures(qc.channel_failures(qc.of_channels(df, list(win.CHANNELS), [1]), lim)).select(*ID, F.array_join("failures", ",").alias("failures"), "valid"))(*checked(s, d))
)
register("filter_wide_gate", f"WITH {o.WINDOWS} SELECT subject_id, session_id, 2 * count(*) AS passed FROM win GROUP BY ALL")(
    lambda s, d: qc.channel_failures(profile(s, d), qc.limits(min_zero_run=10**6, **qc.WIDE_GATE)).filter(F.size("failures") == 0).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("passed"))
)
_HANN = "list_transform(range(64), lambda i: (x[i + 1] - mu) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / 64)))"
_WELCH = "list_transform(range(33), lambda k: (CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END) * (list_sum(list_transform(range(64), lambda i: h[i + 1] * cos(2 * pi() * k * i / 64))) ** 2 + list_sum(list_transform(range(64), lambda i: h[i + 1] * sin(2 * pi() * k * i / 64))) ** 2))"
register(
    "qc_powerline",
    f"WITH e AS ({_E}), m AS (SELECT *, list_avg(x) AS mu FROM e), w AS (SELECT vec_id, {_HANN} AS h FROM m), p AS (SELECT vec_id, {_WELCH} AS p FROM w),"
    " s AS (SELECT vec_id, (p[16] / 2 + p[17] + p[18] / 2) / (list_sum(p) - (p[1] + p[33]) / 2) AS share FROM p) SELECT vec_id, round(share, 6) AS share, share > 0.08::DOUBLE AS powerline FROM s",
)(
    lambda s, d: rounded(embedding_profile(s, d).withColumns({"std": F.lit(1.0), "share": dsp.mains_column(F.col("x"), 200.0)}).select("vec_id", "share", qc.reasons(qc.limits(max_mains=0.08), rate=200.0)["powerline"].alias("powerline")))
)
derived("qc_rate", "qc_account", "subject_id, rejection_rate")
register("qc_worst_sessions", f"WITH {o.CHECKS}, s AS (SELECT subject_id, session_id, {_ACC} FROM qc GROUP BY ALL) SELECT subject_id, session_id, rejection_rate FROM s ORDER BY rejection_rate DESC, subject_id, session_id LIMIT 5")(
    lambda s, d: rounded(qc.account(gated(s, d), *KEYS)).select(*KEYS, "rejection_rate").orderBy(F.desc("rejection_rate"), *KEYS).limit(5)
)

# Faults

_SPANS = {
    "dropout": "CASE WHEN i BETWEEN 26 AND 38 THEN 0 ELSE x[i] END",
    "clipping": "CASE WHEN i BETWEEN 20 AND 25 THEN 1.0 ELSE x[i] END",
    "saturation": "greatest(-1.0, least(1.0, x[i] * 10))",
    "baseline_offset": "x[i] + 0.5",
    "noise_burst": f"x[i] + 0.5 * {arrays.noise(64, 32, 41)}[i]",
}
for _mode, _sql in _SPANS.items():
    _name = {"baseline_offset": "inj_offset", "noise_burst": "inj_noise"}.get(_mode, f"inj_{_mode}")
    register(_name, f"WITH e AS ({_E}), f AS (SELECT vec_id, list_transform(range(1, 65), lambda i: ({_sql})::DOUBLE) AS y FROM e) SELECT vec_id, round(list_avg(y), 6) AS mean, round({_RMS.format(x='y')}, 6) AS rms FROM f")(
        lambda s, d, m=_mode: rounded(signals.embedding_windows(s, d).withColumn("y", arrays.inject(F.col("x"), m, 64)).select("vec_id", arrays.mean(F.col("y")).alias("mean"), arrays.rms(F.col("y")).alias("rms")))
    )


def embedding_profile(spark, sf_dir):
    x = F.col("x")
    return signals.embedding_windows(spark, sf_dir).select("vec_id", "x", arrays.rms(x).alias("rms"), arrays.mean(x).alias("mean"), F.array_max(F.transform(x, F.abs)).alias("absmax"))


def detection(spark, sf_dir):
    """Share of windows that the checks find at fault, by mode, at default strengths and at strengths scaled to the profile."""
    e = embedding_profile(spark, sf_dir)
    scale = qc.corruption_settings(e)
    limit, gain, amount = F.col("rail"), F.col("gain"), F.col("offset")
    given = {"saturation": {"limit": limit, "gain": gain}, "clipping": {"limit": limit}, "baseline_offset": {"amount": amount}, "noise_burst": {"amount": amount}}
    e = e.select("vec_id", "x").crossJoin(F.broadcast(scale))
    modes = [F.struct(F.lit(m).alias("mode"), F.lit(k).alias("severity"), arrays.inject(F.col("x"), m, 64, **(given.get(m, {}) if k == "scaled" else {})).alias("y")) for m in arrays.MODES for k in ("default", "scaled")]
    y = F.col("y")
    m = arrays.mean(y)
    std = F.sqrt(arrays.mean(F.transform(y, lambda v: (v - m) * (v - m))))
    long = e.select("vec_id", F.explode(F.array(*modes)).alias("f")).select("vec_id", "f.*").select("vec_id", "mode", "severity", y.alias("x"), std.alias("std"), m.alias("mean"), arrays.rms(y).alias("rms"))
    failed = qc.channel_failures(long, qc.limits(max_offset=0.4))
    return failed.groupBy("mode", "severity").agg(F.avg((F.size("failures") > 0).cast("double")).alias("detected"))


_SCALED = {"dropout": _SPANS["dropout"], "clipping": "CASE WHEN i BETWEEN 20 AND 25 THEN rail ELSE x[i] END", "saturation": "greatest(-rail, least(rail, x[i] * gain))", "baseline_offset": "x[i] + amount", "noise_burst": f"x[i] + amount * {arrays.noise(64, 32, 41)}[i]"}
_EPROF = f"e AS ({_E}), prof AS (SELECT vec_id, x, {_RMS.format(x='x')} AS rms, list_max(list_transform(x, lambda v: abs(v))) AS absmax FROM e), sc AS (SELECT quantile_cont(absmax, 0.999) * 3 AS rail, quantile_cont(rms, 0.5) AS typical FROM prof), sev AS (SELECT rail, typical, typical * 3 AS amount, CASE WHEN typical = 0 THEN 10 ELSE 3 * rail / typical END AS gain FROM sc)"
register(
    "inj_detection_rate",
    f"WITH {_EPROF}, hurt AS ("
    + " UNION ALL ".join(f"SELECT '{m}' AS mode, '{k}' AS severity, list_transform(range(1, 65), lambda i: ({q[m]})::DOUBLE) AS x FROM e, sev" for k, q in (("default", _SPANS), ("scaled", _SCALED)) for m in arrays.MODES)
    + f"""), st AS (SELECT *, list_avg(x) AS mean, {_RMS.format(x="x")} AS rms FROM hurt), sd AS (SELECT *, sqrt(list_avg(list_transform(x, lambda v: (v - mean) * (v - mean)))) AS std FROM st),
    bad AS (SELECT mode, severity, std < 1e-6 OR {o.run("x", "abs(v) < greatest(1e-6, std * 0.01)")} >= 10 OR len(list_filter(x, lambda v: abs(v) >= 1.0)) / 64.0::DOUBLE > 0.05 OR {o.run("x", "abs(v) >= 1.0")} >= 5 OR rms < 1e-3 OR rms > 5 OR abs(mean) > 0.4 AS bad FROM sd)
    SELECT mode, severity, round(avg(bad::INT), 6) AS detected FROM bad GROUP BY mode, severity""",
)(lambda s, d: rounded(detection(s, d)))


def burst_sweep(spark, sf_dir):
    """Flag rate of a one-class detector over severity and length of noise bursts, a column a length."""
    clean = embedding_profile(spark, sf_dir).withColumn("crest", arrays.crest(F.col("x")))
    detector = models.OneClass.fit(clean, ["rms", "crest"])
    typical = exact_quantiles(clean, {"t": (F.col("rms"), 0.5)})["t"]
    grid = [(severity, length) for severity in (1, 2, 3, 5, 8, 12) for length in (0.15, 0.40)]
    bursts = [F.struct(F.lit(k).alias("severity"), F.lit(int(n * 100)).alias("length"), arrays.inject(F.col("x"), "noise_burst", 64, amount=typical * k, length=n).alias("y")) for k, n in grid]
    y = F.col("f.y")
    hurt = clean.select(F.explode(F.array(*bursts)).alias("f")).select("f.severity", "f.length", arrays.rms(y).alias("rms"), arrays.crest(y).alias("crest"))
    return hurt.groupBy("severity").agg(*(F.avg(F.when(F.col("length") == n, detector.flag().cast("double"))).alias(f"len_{n}pct") for n in (15, 40)))


_DIST = "sqrt((vb * (rms - ma) ** 2 - 2 * c * (rms - ma) * (crest - mb) + va * (crest - mb) ** 2) / (va * vb - c * c))"
register(
    "inj_burst_sweep",
    f"WITH {_EPROF}, f AS (SELECT x, rms, absmax / rms AS crest FROM prof), st AS (SELECT avg(rms) AS ma, avg(crest) AS mb, var_samp(rms) + 1e-6 AS va, var_samp(crest) + 1e-6 AS vb, covar_samp(rms, crest) AS c FROM f),"
    f" thr AS (SELECT quantile_cont({_DIST}, 0.975) AS thr FROM f, st),"
    + " hurt AS (" + " UNION ALL ".join(f"SELECT {k} AS severity, {int(n * 100)} AS length, list_transform(range(1, 65), lambda i: (x[i] + typical * {k} * {arrays.noise(64, *arrays.span(64, 0.5, n))}[i])::DOUBLE) AS y FROM f, sev" for k in (1, 2, 3, 5, 8, 12) for n in (0.15, 0.40)) + "),"
    f" g AS (SELECT severity, length, {_RMS.format(x='y')} AS rms, list_max(list_transform(y, lambda v: abs(v))) AS m FROM hurt), h AS (SELECT severity, length, rms, m / rms AS crest FROM g)"
    f" SELECT severity, round(avg(({_DIST} > thr)::INT) FILTER (length = 15), 6) AS len_15pct, round(avg(({_DIST} > thr)::INT) FILTER (length = 40), 6) AS len_40pct FROM h, st, thr GROUP BY severity",
)(lambda s, d: rounded(burst_sweep(s, d)))

# Aggregates

register("agg_profile", f"WITH {o.CHANNELS} SELECT subject_id, session_id, seq, channel, round(rms, 6) AS rms, round(abs(mean), 6) AS abs_mean, round(absmax, 6) AS abs_max FROM chan")(
    lambda s, d: rounded(profile(s, d).select(*ID, "channel", "rms", F.abs("mean").alias("abs_mean"), F.col("absmax").alias("abs_max")))
)
_P = (0.001, 0.01, 0.5, 0.99, 0.999)
register("agg_percentiles", f"WITH {o.CHANNELS} SELECT " + ", ".join(f"round(quantile_cont(rms, {p}), 6) AS p{k}" for k, p in enumerate(_P)) + " FROM chan")(lambda s, d: (lambda w: rounded(qc.one_row(w, exact_quantiles(w, {f"p{k}": (F.col("rms"), p) for k, p in enumerate(_P)}))))(profile(s, d)))
register("agg_thresholds", f"WITH {o.THRESHOLDS} SELECT {r('min_rms, flatline_std, max_rms, max_offset, saturation_limit')} FROM thr")(lambda s, d: rounded(tight_limits(windows(s, d))))
register(
    "agg_corruption_kwargs",
    f"WITH {o.CHANNELS}, c AS (SELECT quantile_cont(absmax, 0.999) * 3 AS rail, quantile_cont(rms, 0.5) AS typical FROM chan) SELECT {r('rail, typical')}, round(CASE WHEN typical = 0 THEN 10 ELSE 3 * rail / typical END, 6) AS gain, round(typical * 3, 6) AS \"offset\" FROM c",
)(lambda s, d: rounded(qc.corruption_settings(profile(s, d))))
_CAL = " UNION ALL ".join(f"SELECT 'profile' AS section, '{a}_p{p:g}'".replace(".", "_") + f" AS name, quantile_cont({c}, {p / 100!r}) AS value, NULL AS derivation FROM chan" for a, c in (("rms", "rms"), ("abs_mean", "abs(mean)"), ("abs_max", "absmax")) for p in qc.PROFILED)
_CAL += " UNION ALL SELECT 'profile', 'n', count(*), NULL FROM chan"
_CAL += "".join(
    f" UNION ALL SELECT 'thresholds', '{k}', quantile_cont({c}, {q}) * {m}, '{qc.derivation(k)}' FROM chan"
    for k, c, q, m in (("min_rms", "rms", 0.001, 0.1), ("flatline_std", "rms", 0.001, 0.1), ("max_rms", "rms", 0.999, 3), ("max_offset", "abs(mean)", 0.999, 3), ("saturation_limit", "absmax", 0.999, 3))
)
_CAL += " UNION ALL SELECT 'faults', unnest(['rail', 'typical', 'gain', 'offset']), unnest([rail, typical, CASE WHEN typical = 0 THEN 10 ELSE 3 * rail / typical END, typical * 3]), NULL FROM (SELECT quantile_cont(absmax, 0.999) * 3 AS rail, quantile_cont(rms, 0.5) AS typical FROM chan)"
register("agg_calibrate", f"WITH {o.CHANNELS}, cal AS ({_CAL}) SELECT section, name, round(value, 6) AS value, derivation FROM cal")(lambda s, d: rounded(qc.calibrate(win.long_by_channel(saved_windows(s, d), names=("rms", "mean", "absmax")))))
_COV = ["rms_ch0", "wl_ch0", "rms_ch1"]
register(
    "agg_moments_cov",
    f"WITH {o.WINDOWS} SELECT count(*) AS n, " + ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in _COV) + ", " + ", ".join(f"round(covar_samp({a}, {b}), 6) AS cov_{a}_{b}" for i, a in enumerate(_COV) for b in _COV[i:]) + " FROM win WHERE pure",
)(lambda s, d: rounded(models.moments(windows(s, d).filter("pure"), _COV)))
register("agg_group_subject_session", f"WITH {o.PURE} SELECT subject_id, session_id, count(*) AS n, min(seq) AS first, max(seq) AS last FROM pw GROUP BY ALL")(lambda s, d: pure(s, d).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last")))
register("agg_sessions_by_subject", f"WITH {o.PURE} SELECT subject_id, string_agg(DISTINCT session_id, ',' ORDER BY session_id) AS sessions FROM pw GROUP BY subject_id")(
    lambda s, d: pure(s, d).groupBy("subject_id").agg(F.array_join(F.sort_array(F.collect_set("session_id")), ",").alias("sessions"))
)
register("agg_distinct", f"WITH {o.PURE} SELECT label, repetition, count(*) AS n FROM pw GROUP BY ALL")(lambda s, d: pure(s, d).groupBy("label", "repetition").agg(F.count(F.lit(1)).alias("n")))
register("agg_class_share", f"WITH {o.PURE} SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM pw)::DOUBLE, 6) AS share FROM pw GROUP BY label")(
    lambda s, d: rounded(pure(s, d).groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))))
)

# Splits and set operations

_S = "protocol, split, subject_id, session_id, seq, label, repetition, role"
register("split_within_time", f"WITH {o.WITHIN} SELECT {_S} FROM within_t")(lambda s, d: splits.within_time(pure(s, d)))
register(
    "split_within_rep",
    f"""WITH {o.PURE}, a AS (SELECT *, dense_rank() OVER (PARTITION BY subject_id, session_id, repetition > 0 ORDER BY repetition) AS rnk, row_number() OVER (PARTITION BY subject_id, session_id, repetition > 0 ORDER BY seq) - 1 AS pos,
            count(*) OVER (PARTITION BY subject_id, session_id, repetition > 0) AS n, (SELECT count(DISTINCT repetition) FROM pw q WHERE q.repetition > 0 AND q.subject_id = pw.subject_id AND q.session_id = pw.session_id) AS k FROM pw),
        b AS (SELECT *, CASE WHEN repetition > 0 THEN rnk <= greatest(1, trunc(k * 0.7::DOUBLE)::INT) ELSE pos < trunc(n * 0.7::DOUBLE)::BIGINT END AS tr FROM a WHERE k >= 2)
        SELECT 'within-session' AS protocol, 'within/' || subject_id || '/' || session_id AS split, subject_id, session_id, seq, label, repetition, CASE WHEN tr THEN 'train' ELSE 'test' END AS role FROM b""",
)(lambda s, d: splits.within_repetition(pure(s, d)))
register("split_cross_session", f"WITH {o.CROSS} SELECT {_S} FROM cross_s")(lambda s, d: splits.cross_session(pure(s, d)))
register("split_cross_subject", f"WITH {o.PURE} SELECT 'cross-subject' AS protocol, 'cross-subject/' || t AS split, subject_id, session_id, seq, label, repetition, CASE WHEN subject_id = t THEN 'test' ELSE 'train' END AS role FROM pw, (SELECT DISTINCT subject_id AS t FROM pw)")(
    lambda s, d: splits.cross_subject(pure(s, d))
)
_SEEDED = "row_number() OVER (ORDER BY md5('0|' || subject_id || '|' || session_id || '|' || seq))"
register(
    "split_random",
    f"WITH {o.PURE} SELECT 'random-shuffle' AS protocol, 'random-shuffle' AS split, subject_id, session_id, seq, label, repetition, CASE WHEN {_SEEDED} <= trunc((SELECT count(*) FROM pw) * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS role FROM pw",
)(lambda s, d: splits.random_shuffle(pure(s, d)))
register(
    "split_cal_class",
    f"WITH {o.CROSS}, c AS (SELECT *, row_number() OVER (PARTITION BY split, role, label ORDER BY subject_id, session_id, seq) AS k FROM cross_s) SELECT protocol, split || '+cal2' AS split, subject_id, session_id, seq, label, repetition, CASE WHEN role = 'test' AND k <= 2 THEN 'train' ELSE role END AS role FROM c",
)(lambda s, d: splits.calibrate_class(splits.cross_session(pure(s, d))))
register(
    "split_cal_reps",
    f"WITH {o.CROSS}, c AS (SELECT *, dense_rank() OVER (PARTITION BY split, role, repetition > 0 ORDER BY repetition) AS k FROM cross_s) SELECT protocol, split || '+cal1rep' AS split, subject_id, session_id, seq, label, repetition, CASE WHEN role = 'test' AND repetition > 0 AND k <= 1 THEN 'train' ELSE role END AS role FROM c",
)(lambda s, d: splits.calibrate_repetitions(splits.cross_session(pure(s, d))))
register("split_validate", f"WITH {o.CROSS} SELECT count(*) AS overlapping FROM (SELECT 1 FROM cross_s GROUP BY split, subject_id, session_id, seq HAVING count(DISTINCT role) > 1)")(
    lambda s, d: splits.overlaps(splits.cross_session(pure(s, d))).agg(F.count(F.lit(1)).alias("overlapping"))
)
register("split_half", f"WITH {o.PURE} SELECT subject_id, session_id, seq, row_number() OVER (PARTITION BY subject_id, session_id ORDER BY seq) <= trunc(count(*) OVER (PARTITION BY subject_id, session_id) / 2)  AS calibrates FROM pw")(
    lambda s, d: pure(s, d).select(*ID, (F.row_number().over(splits.recording().orderBy("seq")) <= F.floor(F.count(F.lit(1)).over(splits.recording()) / 2)).alias("calibrates"))
)
_LATE = "SELECT DISTINCT session_id FROM pw WHERE session_id >= 'd07'"
register("join_semi_isin", f"WITH {o.PURE} SELECT subject_id, session_id, seq FROM pw WHERE session_id IN ({_LATE})")(lambda s, d: (lambda p: p.join(p.filter("session_id >= 'd07'").select("session_id").distinct(), "session_id", "left_semi").select(*ID))(pure(s, d)))
register("join_anti_setdiff", f"WITH {o.PURE} SELECT subject_id, session_id, seq FROM pw WHERE session_id NOT IN ({_LATE})")(lambda s, d: (lambda p: p.join(p.filter("session_id >= 'd07'").select("session_id").distinct(), "session_id", "left_anti").select(*ID))(pure(s, d)))
register("join_split_features", f"WITH {o.WITHIN} SELECT split, role, count(*) AS n, round(avg(rms_ch0), 6) AS rms_ch0 FROM within_t JOIN win USING (subject_id, session_id, seq) GROUP BY ALL")(
    lambda s, d: rounded(splits.within_time(pure(s, d)).join(windows(s, d).select(*ID, "rms_ch0"), ID).groupBy("split", "role").agg(F.count(F.lit(1)).alias("n"), F.avg("rms_ch0").alias("rms_ch0")))
)
_TW = "SELECT protocol, protocol || '/' || subject_id || '/' || session_id AS split, subject_id, session_id, seq, label, repetition, CASE WHEN pos < 60 THEN 'fit' WHEN pos < 120 THEN 'calibrate' WHEN pos < 150 THEN 'test' END AS role FROM p WHERE pos < 150"
register("split_three_way", f"WITH {o.PURE}, p AS (SELECT *, 'three-way' AS protocol, row_number() OVER (PARTITION BY subject_id, session_id ORDER BY seq) - 1 AS pos FROM pw) {_TW}")(lambda s, d: splits.three_way(pure(s, d), 60, 60, 30))
register("split_three_way_shuffled", f"WITH {o.PURE}, p AS (SELECT *, 'three-way-shuffled' AS protocol, row_number() OVER (PARTITION BY subject_id, session_id ORDER BY md5('0|' || subject_id || '|' || session_id || '|' || seq)) - 1 AS pos FROM pw) {_TW}")(
    lambda s, d: splits.three_way(pure(s, d), 60, 60, 30, seed=0)
)
derived("filter_subset", "join_semi_isin", "subject_id, session_id, seq")

# Metrics

_HIT = "avg((y_true = y_pred)::INT)"
_BIN = "CASE " + " ".join(f"WHEN confidence <= {e!r}::DOUBLE THEN {k}" for k, e in enumerate(metrics.EDGES[1:10])) + " ELSE 9 END"
_SCALE = "CASE WHEN confidence < 0.4::DOUBLE THEN 0 WHEN confidence < 0.7::DOUBLE THEN (confidence - 0.4::DOUBLE) / (0.7::DOUBLE - 0.4::DOUBLE) ELSE 1 END"
_ON = f"({_SCALE} > 0 AND y_pred <> 0)"
register("met_accuracy", f"WITH {o.PREDICTIONS} SELECT subject_id, round({_HIT}, 6) AS accuracy FROM pred GROUP BY subject_id")(lambda s, d: rounded(metrics.accuracy(predictions(s, d), "subject_id")))
register("met_balanced", f"WITH {o.PREDICTIONS} SELECT subject_id, round(avg(r), 6) AS balanced_accuracy FROM (SELECT subject_id, y_true, {_HIT} AS r FROM pred GROUP BY ALL) GROUP BY subject_id")(lambda s, d: rounded(metrics.balanced_accuracy(predictions(s, d), "subject_id")))
_BINS = f"bins AS (SELECT {_BIN} AS bin, count(*) AS n, avg(confidence) AS mean_confidence, {_HIT} AS accuracy FROM pred GROUP BY ALL)"
register("met_ece", f"WITH {o.PREDICTIONS}, {_BINS} SELECT round(sum(n * abs(accuracy - mean_confidence)) / sum(n), 6) AS ece FROM bins")(lambda s, d: rounded(metrics.expected_calibration_error(predictions(s, d))))
register("met_reliability", f"WITH {o.PREDICTIONS}, {_BINS} SELECT b.bin, coalesce(n, 0) AS n, round(mean_confidence, 6) AS mean_confidence, round(accuracy, 6) AS accuracy FROM (SELECT unnest(range(10))::INT AS bin) b LEFT JOIN bins USING (bin)")(
    lambda s, d: rounded(metrics.reliability(predictions(s, d)).select("bin", "n", F.nanvl("mean_confidence", F.lit(None)).alias("mean_confidence"), F.nanvl("accuracy", F.lit(None)).alias("accuracy")))
)
register("met_safety", f"WITH {o.PREDICTIONS} SELECT subject_id, round(avg(({_ON} AND y_true = 0)::INT), 6) AS unsafe_assist_rate, round(avg({_ON}::INT) FILTER (y_true <> 0), 6) AS assist_availability FROM pred GROUP BY subject_id")(
    lambda s, d: rounded(metrics.safety(predictions(s, d), "subject_id"))
)
derived("met_unsafe", "met_safety", "subject_id, unsafe_assist_rate")
derived("met_avail", "met_safety", "subject_id, assist_availability")
_SWEEP = "curve AS (SELECT tau, avg((confidence >= tau AND y_pred <> 0 AND y_true = 0)::INT) AS unsafe, avg((confidence >= tau AND y_pred <> 0)::INT) FILTER (y_true <> 0) AS availability FROM pred, (SELECT round(0.5 + 0.05 * unnest(range(10)), 2)::DOUBLE AS tau) GROUP BY tau)"
register("met_sweep", f"WITH {o.PREDICTIONS}, {_SWEEP} SELECT tau, {r('unsafe, availability')} FROM curve")(lambda s, d: rounded(metrics.sweep(predictions(s, d))))
register("met_policy_pick", f"WITH {o.PREDICTIONS}, {_SWEEP} SELECT coalesce(min(tau) FILTER (unsafe <= 0.15), 0.5)::DOUBLE AS tau FROM curve")(lambda s, d: metrics.first_safe_tau(metrics.sweep(predictions(s, d)), 0.15))


XY = ["rms_ch0", "wl_ch0"]


def by_split(spark, sf_dir, fit=models.discriminants):
    """A model of each subject's first session, and all metrics of each later session, in one aggregation each."""
    w = win.binary_labels(windows(spark, sf_dir).filter("pure")).select(*ID, "label", *XY)
    train, test = splits.cross_session_sides(w)
    return models.evaluate_splits(train, test, XY, fit, "subject_id")


_ROWS = "rws AS (SELECT split, role, c.subject_id, c.session_id, c.seq, (c.label <> 0)::INT AS y, rms_ch0 AS a, wl_ch0 AS b FROM cross_s c JOIN win USING (subject_id, session_id, seq))"


def _evaluated(name: str, keys: str) -> str:
    """CTE ev: the metrics of the rows of name by keys."""
    return f"""ev AS (SELECT {keys}, count(*) AS n_test, {_HIT} AS accuracy, avg(({_ON} AND y_true = 0)::INT) AS unsafe_assist_rate, coalesce(avg({_ON}::INT) FILTER (y_true <> 0), 'nan'::DOUBLE) AS assist_availability FROM {name} GROUP BY ALL),
bal AS (SELECT {keys}, avg(rc) AS balanced_accuracy FROM (SELECT {keys}, y_true, {_HIT} AS rc FROM {name} GROUP BY ALL) GROUP BY ALL),
cal AS (SELECT {keys}, sum(n * gap) / sum(n) AS ece FROM (SELECT {keys}, {_BIN} AS bin, count(*) AS n, abs({_HIT} - avg(confidence)) AS gap FROM {name} GROUP BY ALL) GROUP BY ALL)"""


_BY = f"{_ROWS}, {o.lda('pr', 'rws')}, {_evaluated('pr', 'split')}, m AS (SELECT * FROM ev JOIN bal USING (split) JOIN cal USING (split) JOIN (SELECT split, count(*) AS n_train FROM rws WHERE role = 'train' GROUP BY split) USING (split))"
_METRICS = "accuracy, balanced_accuracy, ece, unsafe_assist_rate, assist_availability"
register("met_evaluate_splits", f"WITH {o.CROSS}, {_BY} SELECT split, n_train, n_test, {r(_METRICS)} FROM m")(lambda s, d: rounded(by_split(s, d)))
register(
    "agg_summarize",
    f"WITH {o.CROSS}, {_BY} SELECT split_part(split, '/', 2) AS subject_id, count(*) AS n_splits, " + ", ".join(f"round({f}({c}), 6) AS {c}_{n}" for c in ("accuracy", "ece") for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))) + " FROM m GROUP BY ALL",
)(lambda s, d: rounded(metrics.summarize(by_split(s, d).withColumn("subject_id", F.split("split", "/")[1]), ["accuracy", "ece"], "subject_id")))
register(
    "agg_by_elapsed",
    f"WITH {o.CROSS}, {_BY} SELECT elapsed, round(avg(accuracy), 6) AS accuracy FROM m JOIN tests ON split = 'cross-session/' || tests.subject_id || '/' || t GROUP BY elapsed",
)(
    lambda s, d: rounded(
        by_split(s, d).withColumn("elapsed", F.dense_rank().over(Window.partitionBy(F.split("split", "/")[1]).orderBy("split")).cast("long")).groupBy("elapsed").agg(F.avg("accuracy").alias("accuracy"))
    )
)
register(
    "proj_as_row",
    f"WITH {o.CROSS}, t AS (SELECT split, protocol, any_value(subject_id) AS subject_id, string_agg(DISTINCT session_id, ',' ORDER BY session_id) FILTER (role = 'train') AS meta_train, string_agg(DISTINCT session_id, ',' ORDER BY session_id) FILTER (role = 'test') AS meta_test, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test FROM cross_s GROUP BY split, protocol)"
    " SELECT protocol, split, n_train, n_test, subject_id AS meta_subject, meta_train, meta_test FROM t",
)(
    lambda s, d: metrics.as_row(
        splits.cross_session(pure(s, d)).groupBy("protocol", "split").agg(
            F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "test").alias("n_test"), F.min("subject_id").alias("subject"),
            *(F.array_sort(F.collect_set(F.when(F.col("role") == k, F.col("session_id")))).alias(f"{k}_sessions") for k in ("train", "test")),
        ),
        {"subject": "subject", "train": "train_sessions", "test": "test_sessions"},
    )
)


def one_model(spark, sf_dir, columns=XY):
    """All windows by a discriminant of the first session's."""
    w = win.binary_labels(windows(spark, sf_dir).filter("pure"))
    return models.Discriminant.fit(w.filter("session_id = 'd00'"), list(columns)).predict(w.select(*ID, "label", *columns))


def _one(name: str, a: str, b: str) -> str:
    rows = f"{name}_r AS (SELECT 'all' AS split, role, subject_id, session_id, seq, (label <> 0)::INT AS y, {a} AS a, {b} AS b FROM win, (SELECT unnest(['train', 'test']) AS role) WHERE pure AND (role = 'test' OR session_id = 'd00'))"
    return f"{rows}, {o.lda(name, f'{name}_r')}"


register("ml_lda", f"WITH {o.WINDOWS}, {_one('p', 'rms_ch0', 'wl_ch0')} SELECT subject_id, session_id, seq, y_pred, round(confidence, 6) AS confidence FROM p")(lambda s, d: rounded(one_model(s, d).select(*ID, "y_pred", "confidence")))
register("ml_argmax", f"WITH e AS ({_E}) SELECT vec_id, (list_position(x[1:8], list_max(x[1:8])) - 1)::INT AS y_pred, round(list_max(x[1:8]), 6) AS confidence FROM e")(
    lambda s, d: rounded(models.predicted(signals.embedding_windows(s, d), F.slice("x", 1, 8), list(range(8))).select("vec_id", "y_pred", "confidence"))
)


@register("ml_logreg")
def ml_logreg(spark, sf_dir):
    """Metrics of all splits of penalised logistic regressions; no SQL maximises a likelihood, a test holds the fits against plain Newton."""
    return rounded(by_split(spark, sf_dir, models.logistic_by))


def subject_results(spark, sf_dir):
    """Metrics by subject within the session that the discriminant was fitted on and across the later ones."""
    p = one_model(spark, sf_dir).withColumns({"y_true": F.col("label"), "kind": F.when(F.col("session_id") == "d00", "within").otherwise("cross")})
    return metrics.per_subject(metrics.evaluate(p, "subject_id", "kind"))


_SUBJECTS = f"{_one('p', 'rms_ch0', 'wl_ch0')}, k AS (SELECT *, CASE WHEN session_id = 'd00' THEN 'within' ELSE 'cross' END AS kind FROM p), {_evaluated('k', 'subject_id, kind')}, mm AS (SELECT * FROM ev JOIN bal USING (subject_id, kind) JOIN cal USING (subject_id, kind)),"
_SUBJECTS += " sb AS (SELECT subject_id, " + ", ".join(f"max({c}) FILTER (kind = '{k}') AS {k}_{n}" for c, n in (("balanced_accuracy", "bal"), ("ece", "ece"), ("unsafe_assist_rate", "unsafe"), ("assist_availability", "avail")) for k in ("within", "cross")) + " FROM mm GROUP BY subject_id),"
_SUBJECTS += " subj AS (SELECT *, cross_bal - within_bal AS d_bal, cross_ece - within_ece AS d_ece, cross_ece / within_ece AS ece_ratio FROM sb)"
register("agg_per_subject_delta", f"WITH {o.WINDOWS}, {_SUBJECTS} SELECT subject_id, {r(', '.join(metrics.STUDIED))} FROM subj")(lambda s, d: rounded(subject_results(s, d)))
register("agg_across_subjects", f"WITH {o.WINDOWS}, {_SUBJECTS} SELECT count(*) AS n_subjects, " + ", ".join(f"round(avg({c}), 6) + 0::DOUBLE AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_sd" for c in metrics.STUDIED) + " FROM subj")(
    lambda s, d: rounded(metrics.across_subjects(subject_results(s, d)))
)
register(
    "agg_central_test",
    f"WITH {o.WINDOWS}, {_SUBJECTS} SELECT round(avg(d_bal / within_bal), 6) + 0::DOUBLE AS drop_mean, round(stddev_pop(d_bal / within_bal), 6) AS drop_sd, round(avg(ece_ratio), 6) AS ratio_mean, round(quantile_cont(ece_ratio, 0.5), 6) AS ratio_median, count(ece_ratio) AS n_ratios, count(*) FILTER (ece_ratio > 1) AS worse, count(*) FILTER (ece_ratio >= 1.5) AS much_worse FROM subj",
)(lambda s, d: rounded(metrics.central_test(subject_results(s, d))))

# Decision and safety


def ticks(spark, sf_dir):
    c0, c1 = F.col("ch0"), F.col("ch1")
    return sample_rows(spark, sf_dir).select(
        *KEYS, F.col("sample_idx").alias("i"), (c0 >= -0.8).alias("valid"), ((c1 + 1) * 0.05).alias("latency"), (c0 > -0.4).alias("intent"), F.least(F.lit(1.0), (c0 + 1) / 1.6).alias("confidence"),
        (c0 < 4).alias("safety_ok"), (c0 > 8).alias("emergency"), (c1 > 0.95).alias("reset"),
    )


register("gate_confidence", f"WITH {o.TICKS} SELECT subject_id, session_id, i, confidence >= 0.4::DOUBLE AS allowed, round({_SCALE}, 6) AS scale FROM tick")(
    lambda s, d: rounded(ticks(s, d).select(*KEYS, "i", metrics.gate_allows(F.col("confidence")).alias("allowed"), metrics.gate_scale(F.col("confidence")).alias("scale")))
)
_FSM = """ep AS (SELECT *, sum(reset::INT) OVER (PARTITION BY subject_id, session_id ORDER BY i) AS epoch FROM tick),
st AS (SELECT *, CASE WHEN max(emergency::INT) OVER e = 1 THEN 'EMERGENCY_STOP' WHEN max((NOT safety_ok)::INT) OVER e = 1 THEN 'FALLBACK'
    WHEN intent AND confidence >= 0.7::DOUBLE THEN 'ASSIST' WHEN intent AND confidence >= 0.4::DOUBLE THEN 'DEGRADED' ELSE 'IDLE' END AS state FROM ep WINDOW e AS (PARTITION BY subject_id, session_id, epoch ORDER BY i))"""
register("fsm_step", f"WITH {o.TICKS}, {_FSM} SELECT subject_id, session_id, i, state FROM st")(lambda s, d: decision.states(ticks(s, d), *KEYS).select(*KEYS, "i", "state"))
register("fsm_reset", f"WITH {o.TICKS}, {_FSM} SELECT subject_id, session_id, i, state FROM st WHERE reset")(lambda s, d: decision.states(ticks(s, d), *KEYS).filter("reset").select(*KEYS, "i", "state"))
register("fsm_transitions", f"WITH {o.TICKS}, {_FSM}, l AS (SELECT *, lag(state, 1, 'IDLE') OVER (PARTITION BY subject_id, session_id ORDER BY i) AS from_state FROM st) SELECT subject_id, session_id, i, from_state, state AS to_state FROM l WHERE from_state <> state")(
    lambda s, d: decision.transitions(decision.states(ticks(s, d), *KEYS), *KEYS)
)
_FAULT = """isl AS (SELECT *, sum(valid::INT) OVER (PARTITION BY subject_id, session_id ORDER BY i) AS island FROM tick),
flt AS (SELECT *, sum((NOT valid)::INT) OVER (PARTITION BY subject_id, session_id, island ORDER BY i)::BIGINT AS missed FROM isl)"""
register("fault_frame", f"WITH {o.TICKS}, {_FAULT} SELECT subject_id, session_id, i, missed, CASE WHEN missed >= 3 THEN 'dropout' WHEN latency > 0.05::DOUBLE THEN 'latency' END AS fault FROM flt")(lambda s, d: decision.faults(ticks(s, d), *KEYS).select(*KEYS, "i", "missed", "fault"))
register("fault_desync", f"WITH {o.SAMPLES} SELECT subject_id, session_id, sample_idx, abs(ch0 - ch1) > 0.02::DOUBLE AS desync FROM smp")(lambda s, d: sample_rows(s, d).select(*KEYS, "sample_idx", decision.desync(F.col("ch0"), F.col("ch1")).alias("desync")))
register("fallback_select", f"WITH {o.TICKS} SELECT subject_id, session_id, i, CASE WHEN NOT safety_ok THEN 'PASSIVE' WHEN confidence < 0.4::DOUBLE THEN 'LIMITED_ASSIST' ELSE 'NONE' END AS mode FROM tick")(
    lambda s, d: ticks(s, d).select(*KEYS, "i", decision.fallback(~F.col("safety_ok"), F.col("confidence")).alias("mode"))
)
register("limit_enforce", f"WITH {o.SAMPLES} SELECT subject_id, session_id, sample_idx, round(CASE WHEN ch0 BETWEEN 0 AND 2.35::DOUBLE AND abs(ch1) <= 3 THEN greatest(-5, least(5, ch0 * 4)) ELSE 0 END, 6) AS torque FROM smp")(
    lambda s, d: rounded(sample_rows(s, d).select(*KEYS, "sample_idx", decision.enforce(F.col("ch0") * 4, F.col("ch0"), F.col("ch1")).alias("torque")))
)
register("limit_clamp", f"WITH {o.SAMPLES} SELECT subject_id, session_id, sample_idx, round(greatest(-5, least(5, ch0 * 4)), 6) AS torque FROM smp")(lambda s, d: rounded(sample_rows(s, d).select(*KEYS, "sample_idx", decision.clamp(F.col("ch0") * 4).alias("torque"))))


_LOOP_STREAM = f"""{o.TICKS}, {_FAULT}, faulty AS (SELECT *, CASE WHEN missed >= 3 THEN 'dropout' WHEN latency > 0.05::DOUBLE THEN 'latency' END AS fault FROM flt),
ep2 AS (SELECT *, sum(reset::INT) OVER (PARTITION BY subject_id, session_id ORDER BY i) AS epoch, safety_ok AND fault IS NULL AS fine FROM faulty),
st2 AS (SELECT *, CASE WHEN max(emergency::INT) OVER e = 1 THEN 'EMERGENCY_STOP' WHEN max((NOT fine)::INT) OVER e = 1 THEN 'FALLBACK'
    WHEN intent AND confidence >= 0.7::DOUBLE THEN 'ASSIST' WHEN intent AND confidence >= 0.4::DOUBLE THEN 'DEGRADED' ELSE 'IDLE' END AS state FROM ep2 WINDOW e AS (PARTITION BY subject_id, session_id, epoch ORDER BY i))"""


@register("loop_stream", f"WITH {_LOOP_STREAM} SELECT subject_id || '/' || session_id AS run_id, i, missed::INT AS missed, fault, state FROM st2")
def loop_stream(spark, sf_dir):
    """Recorded ticks replayed as a stream through the state machine, stopped and started once in the middle of all runs, into a sink whose batches count once."""
    at = storage.fresh_path(spark, "loop")
    t = ticks(spark, sf_dir).withColumn("run_id", F.concat_ws("/", *KEYS)).drop(*KEYS)
    t = t.withColumn("half", (F.col("i") * 2 >= F.count(F.lit(1)).over(Window.partitionBy("run_id"))).cast("int"))
    t.write.partitionBy("half").parquet(f"{at}/dealt")
    sink, schema = storage.EpochSink(spark, f"{at}/out"), t.drop("half").schema
    for half in range(2):
        spark.read.schema(schema).parquet(f"{at}/dealt/half={half}").write.mode("append").parquet(f"{at}/in")
        out = control.run_loop(control.replay(spark, f"{at}/in", schema))
        out.writeStream.foreachBatch(sink).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return sink.read(out.schema)


def loop(spark, sf_dir):
    t = decision.states(ticks(spark, sf_dir), *KEYS)
    mode = decision.fallback(~F.col("safety_ok"), F.col("confidence"))
    return t.withColumn("mode", mode).withColumn("torque", decision.torque(F.col("state"), F.col("confidence"), F.col("mode")))


_TORQUE = f"""lp AS (SELECT *, CASE WHEN state IN ('ASSIST', 'DEGRADED') AND confidence >= 0.4::DOUBLE AND mode = 'NONE' THEN 2.0 * {_SCALE} WHEN mode = 'LIMITED_ASSIST' THEN 0.4 ELSE 0 END::DOUBLE AS torque FROM
    (SELECT *, CASE WHEN NOT safety_ok THEN 'PASSIVE' WHEN confidence < 0.4::DOUBLE THEN 'LIMITED_ASSIST' ELSE 'NONE' END AS mode FROM st))"""
register("loop_torque_rule", f"WITH {o.TICKS}, {_FSM}, {_TORQUE} SELECT subject_id, session_id, i, round(torque, 6) AS torque FROM lp")(lambda s, d: rounded(loop(s, d).select(*KEYS, "i", "torque")))
_PLANT = """run AS (
        SELECT DISTINCT subject_id, session_id, -1::BIGINT AS i, 0::DOUBLE AS applied, 0::DOUBLE AS angle, 0::DOUBLE AS velocity FROM lp
        UNION ALL SELECT subject_id, session_id, i, applied, greatest(-2.5, least(2.5, g)), CASE WHEN abs(g) > 2.5 THEN 0 ELSE v END FROM (SELECT *, angle + v * 0.05::DOUBLE AS g FROM (
            SELECT *, velocity + (applied - 0.3::DOUBLE * velocity) / 0.05::DOUBLE * 0.05::DOUBLE AS v FROM (
                SELECT lp.subject_id, lp.session_id, lp.i, angle, velocity, greatest(-5, least(5, applied + greatest(-1.0::DOUBLE, least(1.0::DOUBLE,
                    CASE WHEN angle BETWEEN 0 AND 2.35::DOUBLE AND abs(velocity) <= 3 THEN greatest(-5, least(5, torque)) ELSE 0 END - applied)))) AS applied
                FROM run JOIN lp ON lp.subject_id = run.subject_id AND lp.session_id = run.session_id AND lp.i = run.i + 1))))"""
_APPLIED = f"SELECT subject_id, session_id, i, {r('applied, angle, velocity', 5)} FROM run WHERE i >= 0"
register("plant_run", f"WITH RECURSIVE {o.TICKS}, {_FSM}, {_TORQUE}, {_PLANT} {_APPLIED}")(lambda s, d: rounded(decision.plant(loop(s, d), *KEYS), 5))

# The control loop: frames are tumbling windows of the first channel; those that begin with a large value are flagged as lost.
LIMITS = {"flatline_std": 0.12, "saturation_limit": 2.0, "max_saturated": 0.25}


def frames(spark, sf_dir):
    w = win.sliding(sample_rows(spark, sf_dir), stride=win.WIDTH)
    return w.select(*KEYS, F.col("seq").alias("i"), F.col("x_ch0").alias("x"), (F.col("x_ch0")[0] < 3).alias("valid"), F.lit(0.0).alias("latency"))


def baseline(spark, sf_dir):
    return decision.control(frames(spark, sf_dir), qc.limits(**LIMITS), *KEYS, full=1.4, intent=0.6)


_LOOP = f"""{_TUMBLING}, fr AS (SELECT subject_id, session_id, seq AS i, x_ch0[1] < 3 AS flag, rms_ch0 AS rms,
    CASE WHEN std_ch0 < 0.12::DOUBLE THEN 'dropout' WHEN len(list_filter(x_ch0, lambda v: abs(v) >= 2)) / 8.0::DOUBLE > 0.25::DOUBLE THEN 'saturation' END AS quality FROM win),
il AS (SELECT *, flag AND quality IS NULL AS valid, sum((flag AND quality IS NULL)::INT) OVER (PARTITION BY subject_id, session_id ORDER BY i) AS island FROM fr),
fl AS (SELECT *, sum((NOT valid)::INT) OVER (PARTITION BY subject_id, session_id, island ORDER BY i)::BIGINT AS missed FROM il),
tick AS (SELECT subject_id, session_id, i, quality, missed, CASE WHEN missed >= 3 THEN 'dropout' END AS fault, missed < 3 AS safety_ok, least(1, rms / 1.4::DOUBLE) AS confidence, rms > 0.6::DOUBLE AS intent, false AS emergency, false AS reset FROM fl)"""
register("loop_control", f"WITH {_LOOP}, {_FSM}, {_TORQUE} SELECT subject_id, session_id, i, quality, missed, fault, round(confidence, 6) AS confidence, state, mode, round(torque, 6) AS torque FROM lp")(
    lambda s, d: rounded(baseline(s, d).select(*KEYS, "i", "quality", "missed", "fault", "confidence", "state", "mode", "torque"))
)
register("loop_baseline", f"WITH RECURSIVE {_LOOP}, {_FSM}, {_TORQUE}, {_PLANT} {_APPLIED}")(lambda s, d: rounded(decision.plant(baseline(s, d), *KEYS), 5))
_EVENTS = f"{_LOOP}, {_FSM}, l AS (SELECT *, lag(state, 1, 'IDLE') OVER (PARTITION BY subject_id, session_id ORDER BY i) AS from_state FROM st)"
register(
    "loop_events",
    f"WITH {_EVENTS} SELECT subject_id, session_id, round(i / 20.0::DOUBLE, 6) AS timestamp, 'state_transition' AS kind, from_state || '>' || state AS data FROM l WHERE from_state <> state UNION ALL SELECT subject_id, session_id, round(i / 20.0::DOUBLE, 6), 'safety_event', fault FROM l WHERE fault IS NOT NULL",
)(
    lambda s, d: rounded(
        decision.events(baseline(s, d), *KEYS).select(*KEYS, "timestamp", "kind", F.when(F.col("kind") == "safety_event", F.col("data")["reason"]).otherwise(F.concat_ws(">", F.col("data")["from"], F.col("data")["to"])).alias("data"))
    )
)
register("loop_synth")(
    lambda s, d: rounded(decision.plant(decision.control(signals.synthetic_frames(s), qc.limits(), "run_id"), "run_id"))
)
derived("plant_actuator", "plant_run", "subject_id, session_id, i, applied")
derived("plant_elbow", "plant_run", "subject_id, session_id, i, angle, velocity")

# One-class distances and monitors

_M = "st AS (SELECT avg(rms_ch0) AS ma, avg(wl_ch0) AS mb, var_samp(rms_ch0) + 1e-6 AS va, var_samp(wl_ch0) + 1e-6 AS vb, covar_samp(rms_ch0, wl_ch0) AS c FROM win WHERE pure)"
_D = f"{_M}, dist AS (SELECT subject_id, session_id, seq, sqrt((vb * (rms_ch0 - ma) ** 2 - 2 * c * (rms_ch0 - ma) * (wl_ch0 - mb) + va * (wl_ch0 - mb) ** 2) / (va * vb - c * c)) AS distance FROM win, st WHERE pure)"


def distances(spark, sf_dir):
    w = storage.saved(windows(spark, sf_dir).filter("pure").select(*ID, "rms_ch0", "wl_ch0"), "features")  # read for moments, for the quantile and for the distances
    model = models.OneClass.fit(w, ["rms_ch0", "wl_ch0"])
    return w.select(*ID, model.distance().alias("distance"), model.flag().alias("flag"))


register("anom_distance", f"WITH {o.WINDOWS}, {_D} SELECT subject_id, session_id, seq, round(distance, 6) AS distance FROM dist")(lambda s, d: rounded(distances(s, d).select(*ID, "distance")))
register("agg_quantile", f"WITH {o.WINDOWS}, {_D} SELECT round(quantile_cont(distance, 0.975), 6) AS threshold FROM dist")(lambda s, d: (lambda w: rounded(qc.one_row(w, exact_quantiles(w, {"threshold": (F.col("distance"), 0.975)}))))(distances(s, d)))
register("anom_flag_rate", f"WITH {o.WINDOWS}, {_D} SELECT session_id, round(avg((distance > (SELECT quantile_cont(distance, 0.975) FROM dist))::INT), 6) AS flag_rate FROM dist GROUP BY session_id")(
    lambda s, d: rounded(distances(s, d).groupBy("session_id").agg(F.avg(F.col("flag").cast("double")).alias("flag_rate")))
)
register(
    "anom_adaptive",
    f"WITH {o.WINDOWS}, {_D} SELECT subject_id, session_id, seq, CASE WHEN count(*) OVER w >= 20 THEN round(quantile_cont(distance, 0.975) OVER w, 6) ELSE 'inf'::DOUBLE END AS threshold FROM dist WINDOW w AS (PARTITION BY subject_id, session_id ORDER BY seq ROWS BETWEEN 3999 PRECEDING AND CURRENT ROW)",
)(lambda s, d: models.adaptive_threshold(distances(s, d), "distance", *KEYS, least=20).select(*ID, F.when(F.col("threshold") == float("inf"), F.col("threshold")).otherwise(F.round("threshold", ROUND)).alias("threshold")))
_THRESHOLD = "CASE WHEN count(*) OVER w >= 20 THEN quantile_cont(distance, 0.975) OVER w ELSE 'inf'::DOUBLE END"


@register("anom_stream", f"WITH {o.WINDOWS}, {_D} SELECT subject_id, session_id, seq, round({_THRESHOLD}, 6) AS threshold, distance > {_THRESHOLD} AS flag FROM dist WINDOW w AS (PARTITION BY subject_id, session_id ORDER BY seq ROWS BETWEEN 3999 PRECEDING AND CURRENT ROW)")
def anom_stream(spark, sf_dir):
    """anom_adaptive as a stream that is stopped and started again twice in the middle of all sessions, into a sink whose batches count once."""
    dist = distances(spark, sf_dir).select(*ID, "distance")
    at = storage.fresh_path(spark, "stream")
    sink = storage.EpochSink(spark, f"{at}/out")
    thirds = dist.groupBy(*KEYS).agg(F.max("seq").alias("last"))
    dealt = dist.join(thirds, list(KEYS)).withColumn("third", F.least(F.lit(2), (F.col("seq") * 3 / (F.col("last") + 1)).cast("int"))).drop("last")
    dealt.write.partitionBy("third").parquet(f"{at}/dealt")
    for third in range(3):
        spark.read.schema(dist.schema).parquet(f"{at}/dealt/third={third}").write.mode("append").parquet(f"{at}/in")
        rows = threshold.adaptive_stream(spark.readStream.schema(dist.schema).parquet(f"{at}/in"), "distance", *KEYS, least=20)
        query = rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    out = sink.read(rows.schema)
    return out.select(*ID, F.when(F.col("threshold") == float("inf"), F.col("threshold")).otherwise(F.round("threshold", ROUND)).alias("threshold"), "flag")


_FLAGS = "fr AS (SELECT session_id, avg((distance > (SELECT quantile_cont(distance, 0.975) FROM dist))::INT) AS fixed_fp, avg((distance > thr)::INT) AS adaptive_fp FROM (SELECT *, CASE WHEN count(*) OVER w >= 20 THEN quantile_cont(distance, 0.975) OVER w ELSE 'inf'::DOUBLE END AS thr FROM dist WINDOW w AS (PARTITION BY subject_id, session_id ORDER BY seq ROWS BETWEEN 3999 PRECEDING AND CURRENT ROW)) GROUP BY session_id)"
register("agg_benign_vs_degraded", f"WITH {o.WINDOWS}, {_D}, {_FLAGS} SELECT session_id = 'd04' AS degraded, {', '.join(f'round({f}({c}), 6) AS {c}_{n}' for c in ('fixed_fp', 'adaptive_fp') for n, f in (('mean', 'avg'), ('max', 'max')))} FROM fr GROUP BY ALL")(
    lambda s, d: rounded(
        metrics.benign_against_degraded(
            (lambda dist: dist.join(models.adaptive_threshold(dist, "distance", *KEYS, least=20).select(*ID, "threshold"), ID).groupBy("session_id").agg(F.avg(F.col("flag").cast("double")).alias("fixed_fp"), F.avg((F.col("distance") > F.col("threshold")).cast("double")).alias("adaptive_fp")))(distances(s, d)),
            F.col("session_id") == "d04",
            ["fixed_fp", "adaptive_fp"],
        )
    )
)
register("mon_recall", f"WITH {o.PREDICTIONS} SELECT session_id, round({_HIT} FILTER (y_true = 0), 6) AS rest_recall, round({_HIT} FILTER (y_true <> 0), 6) AS move_recall, round(avg(confidence), 6) AS mean_confidence FROM pred GROUP BY session_id")(
    lambda s, d: rounded(
        predictions(s, d).groupBy("session_id").agg(
            F.avg(F.when(F.col("y_true") == 0, (F.col("y_pred") == 0).cast("double"))).alias("rest_recall"), F.avg(F.when(F.col("y_true") != 0, (F.col("y_true") == F.col("y_pred")).cast("double"))).alias("move_recall"), F.avg("confidence").alias("mean_confidence")
        )
    )
)


def mon_decision(spark, sf_dir):
    """Two models of a channel each, fitted on the first session: confidence, disagreement and predicted movement by session, without labels."""
    second = one_model(spark, sf_dir, ("rms_ch1", "wl_ch1")).select(*ID, F.col("y_pred").alias("y_other"))
    both = one_model(spark, sf_dir).join(second, ID)
    return rounded(both.groupBy("session_id").agg(F.avg("confidence").alias("mean_confidence"), F.avg((F.col("y_pred") != F.col("y_other")).cast("double")).alias("disagreement"), F.avg((F.col("y_pred") != 0).cast("double")).alias("move_share")))


register(
    "mon_decision",
    f"WITH {o.WINDOWS}, {_one('p', 'rms_ch0', 'wl_ch0')}, {_one('q', 'rms_ch1', 'wl_ch1')} SELECT p.session_id, round(avg(p.confidence), 6) AS mean_confidence, round(avg((p.y_pred <> q.y_pred)::INT), 6) AS disagreement, round(avg((p.y_pred <> 0)::INT), 6) AS move_share FROM p JOIN q USING (subject_id, session_id, seq) GROUP BY p.session_id",
)(mon_decision)
