"""DuckDB text shared by the oracles: the same tables that the queries start from."""

SAMPLES = """smp AS (
    SELECT 's0' || (user_id % 5) AS subject_id, 'd0' || (d // 3) AS session_id,
           row_number() OVER (PARTITION BY user_id % 5, d // 3 ORDER BY ts, event_id) - 1 AS sample_idx,
           (d % 3)::INT AS label, (CASE WHEN d % 3 = 0 THEN 0 ELSE 1 + hour(ts) // 6 END)::INT AS repetition,
           (value - 50) / 50 AS ch0, (k - 50) / 50 AS ch1
    FROM (SELECT *, date_diff('day', DATE '2024-01-01', ts::DATE) AS d, json_extract_string(props, '$.k')::DOUBLE AS k FROM events))"""


def _channel(c: str, width: int) -> str:
    return f"""list({c}) OVER w AS x_{c}, sqrt(avg({c} * {c}) OVER w) AS rms_{c}, avg(abs({c})) OVER w AS mav_{c},
        coalesce(sum(CASE WHEN (({c} < 0) <> (p_{c} < 0)) AND abs({c} - p_{c}) > 0 THEN 1.0::DOUBLE ELSE 0 END) OVER w1, 0) / {width - 1} AS zcr_{c},
        coalesce(sum(abs({c} - p_{c})) OVER w1, 0) AS wl_{c},
        coalesce(sum(CASE WHEN (p_{c} - q_{c}) * ({c} - p_{c}) < 0 THEN 1.0::DOUBLE ELSE 0 END) OVER w2, 0) / {width - 2} AS ssc_{c},
        stddev_pop({c}) OVER w AS std_{c}, avg({c}) OVER w AS mean_{c}, max(abs({c})) OVER w AS absmax_{c}"""


LAGGED = """lagged AS (SELECT *, lag(ch0, 1) OVER b AS p_ch0, lag(ch0, 2) OVER b AS q_ch0, lag(ch1, 1) OVER b AS p_ch1, lag(ch1, 2) OVER b AS q_ch1
           FROM smp WINDOW b AS (PARTITION BY subject_id, session_id ORDER BY sample_idx))"""


def sliding(name: str, width: int, stride: int) -> str:
    """A CTE of the windows of one size, over lagged."""
    frame = "(PARTITION BY subject_id, session_id ORDER BY sample_idx ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
    return f"""{name} AS (SELECT *, (sample_idx - {width - 1}) // {stride} AS seq, sample_idx - {width - 1} AS start_idx FROM (
    SELECT subject_id, session_id, sample_idx, label, repetition, min(label) OVER w = max(label) OVER w AS pure, {_channel("ch0", width)}, {_channel("ch1", width)}
    FROM lagged WINDOW w AS {frame.format(width - 1)}, w1 AS {frame.format(width - 2)}, w2 AS {frame.format(width - 3)})
    WHERE sample_idx >= {width - 1} AND (sample_idx - {width - 1}) % {stride} = 0)"""


WINDOWS = f"{SAMPLES}, {LAGGED}, {sliding('win', 8, 2)}"

_RUN = "list_reduce(list_prepend({{'run': 0, 'best': 0}}, list_transform({x}, lambda v: {{'run': CASE WHEN {t} THEN 1 ELSE 0 END, 'best': 0}})), lambda s, v: {{'run': CASE WHEN v.run = 1 THEN s.run + 1 ELSE 0 END, 'best': greatest(s.best, CASE WHEN v.run = 1 THEN s.run + 1 ELSE 0 END)}}).best"


def run(x: str, test: str) -> str:
    return _RUN.format(x=x, t=test)


CHANNELS = f"""{WINDOWS},
chan AS (SELECT subject_id, session_id, seq, label, repetition, pure, 'ch0' AS channel, x_ch0 AS x, rms_ch0 AS rms, mav_ch0 AS mav, std_ch0 AS std, mean_ch0 AS mean, absmax_ch0 AS absmax FROM win
         UNION ALL SELECT subject_id, session_id, seq, label, repetition, pure, 'ch1', x_ch1, rms_ch1, mav_ch1, std_ch1, mean_ch1, absmax_ch1 FROM win)"""

#: Self-calibrated limits, tight enough that some windows fail.
THRESHOLDS = f"""{CHANNELS},
thr AS (SELECT quantile_cont(rms, 0.001) * 0.1 AS min_rms, quantile_cont(rms, 0.001) * 0.1 AS flatline_std, quantile_cont(rms, 0.999) * 0.9 AS max_rms,
               quantile_cont(abs(mean), 0.999) * 0.9 AS max_offset, quantile_cont(absmax, 0.999) * 0.5 AS saturation_limit FROM chan)"""

CHECKS = f"""{THRESHOLDS},
checked AS (SELECT chan.*, std < flatline_std AS dropout, {run("x", "abs(v) < greatest(1e-6, std * 0.01)")} >= 2 AS dropout_run,
    len(list_filter(x, lambda v: abs(v) >= saturation_limit)) / len(x)::DOUBLE > 0.05 AS saturation, {run("x", "abs(v) >= saturation_limit")} >= 2 AS clipping,
    rms < min_rms AS amplitude_low, rms > max_rms AS amplitude_high, abs(mean) > max_offset AS baseline_offset
    FROM chan, thr WHERE pure),
failed AS (SELECT *, list_filter([CASE WHEN dropout OR dropout_run THEN 'dropout' END, CASE WHEN saturation THEN 'saturation' END, CASE WHEN clipping THEN 'clipping' END,
    CASE WHEN amplitude_low THEN 'amplitude_low' END, CASE WHEN amplitude_high THEN 'amplitude_high' END, CASE WHEN baseline_offset THEN 'baseline_offset' END], lambda v: v IS NOT NULL) AS failures FROM checked),
gated AS (SELECT subject_id, session_id, seq, label, max(failures) FILTER (channel = 'ch0') AS f0, max(failures) FILTER (channel = 'ch1') AS f1 FROM failed GROUP BY ALL),
qc AS (SELECT *, f0 || list_filter(f1, lambda v: NOT list_contains(f0, v)) AS failures, len(f0) + len(f1) = 0 AS valid FROM gated)"""

#: Windows of several sizes under fixed limits that no mean of two-digit values meets exactly; the mains are not checked. (width, stride, inspected channels)
BUILDS = ((12, 4, ("ch0", "ch1")), (20, 5, ("ch1",)), (9, 2, ("ch1", "ch0")))
LIMITS = {"min_rms": 0.35, "max_rms": 0.75, "max_offset": 0.30037, "saturation_limit": 0.97, "flatline_std": 0.3, "clip_min_run": 2}


def _failures(c: str) -> str:
    at = f"abs(v) >= {LIMITS['saturation_limit']}::DOUBLE"
    named = {
        "dropout": f"std_{c} < {LIMITS['flatline_std']}::DOUBLE OR {run(f'x_{c}', f'abs(v) < greatest(1e-6, std_{c} * 0.01)')} >= 10",
        "saturation": f"len(list_filter(x_{c}, lambda v: {at})) / len(x_{c})::DOUBLE > 0.05::DOUBLE",
        "clipping": f"{run(f'x_{c}', at)} >= 2",
        "amplitude_low": f"rms_{c} < {LIMITS['min_rms']}::DOUBLE",
        "amplitude_high": f"rms_{c} > {LIMITS['max_rms']}::DOUBLE",
        "baseline_offset": f"abs(mean_{c}) > {LIMITS['max_offset']}::DOUBLE",
    }
    return "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{k}' END" for k, t in named.items()) + "], lambda v: v IS NOT NULL)"


def _built(k: int, width: int, stride: int, channels: tuple) -> str:
    first, *rest = channels
    listed = "f_0" + "".join(f" || list_filter(f_{i}, lambda v: NOT list_contains(f_0, v))" for i in range(1, len(channels)))
    each = ", ".join(f"{_failures(c)} AS f_{i}" for i, c in enumerate(channels))
    return f"SELECT *, {listed} AS failures FROM (SELECT '{width}/{stride}' AS size, *, {each} FROM w{k} WHERE pure)"


BUILT = f"{SAMPLES}, {LAGGED}, " + ", ".join(f"{sliding(f'w{k}', w, s)}" for k, (w, s, _) in enumerate(BUILDS))
BUILT += ", built AS (" + " UNION ALL BY NAME ".join(f"({_built(k, *b)})" for k, b in enumerate(BUILDS)) + ")"

PREDICTIONS = f"""{WINDOWS},
pred AS (SELECT subject_id, session_id, seq, (label <> 0)::INT AS y_true, (rms_ch0 > 0.8)::INT AS y_pred, least(1, rms_ch0 / 1.5) AS confidence FROM win WHERE pure)"""

TICKS = f"""{SAMPLES},
tick AS (SELECT subject_id, session_id, sample_idx AS i, ch0 >= -0.8 AS valid, (ch1 + 1) * 0.05 AS latency, ch0 > -0.4 AS intent, least(1, (ch0 + 1) / 1.6) AS confidence,
                ch0 < 4 AS safety_ok, ch0 > 8 AS emergency, ch1 > 0.95 AS reset FROM smp)"""

PURE = f"{WINDOWS}, pw AS (SELECT subject_id, session_id, seq, label, repetition FROM win WHERE pure)"
WITHIN = f"""{PURE}, wt AS (SELECT 'within-session' AS protocol, 'within/' || subject_id || '/' || session_id AS split, subject_id, session_id, seq, label, repetition,
    CASE WHEN pos < greatest(0, cut - 3) THEN 'train' WHEN pos >= cut THEN 'test' END AS role
    FROM (SELECT *, row_number() OVER r - 1 AS pos, trunc(count(*) OVER (PARTITION BY subject_id, session_id) * 0.7::DOUBLE)::BIGINT AS cut FROM pw WINDOW r AS (PARTITION BY subject_id, session_id ORDER BY seq))),
within_t AS (SELECT * FROM (SELECT * FROM wt WHERE role IS NOT NULL) QUALIFY count(*) FILTER (role = 'train') OVER (PARTITION BY split) > 0 AND count(*) FILTER (role = 'test') OVER (PARTITION BY split) > 0)"""
CROSS = f"""{PURE}, rk AS (SELECT *, dense_rank() OVER (PARTITION BY subject_id ORDER BY session_id) AS r FROM pw),
tests AS (SELECT DISTINCT subject_id, session_id AS t, r - 1 AS elapsed FROM rk WHERE r > 1),
cross_s AS (SELECT 'cross-session' AS protocol, 'cross-session/' || rk.subject_id || '/' || t AS split, rk.subject_id, session_id, seq, label, repetition, 'train' AS role FROM rk JOIN tests USING (subject_id) WHERE r = 1
    UNION ALL SELECT 'cross-session', 'cross-session/' || subject_id || '/' || session_id, subject_id, session_id, seq, label, repetition, 'test' FROM rk WHERE r > 1)"""

def lda(name: str, rows: str) -> str:
    """CTEs that fit a discriminant of the columns a and b a split on the training rows of rows
    (split, role, keys, y, a, b), and as name the test rows with y_true, y_pred and confidence."""
    return f"""{name}_m AS (SELECT split, y, count(*) AS n, avg(a) AS ma, avg(b) AS mb, coalesce(var_samp(a), 0) AS va, coalesce(var_samp(b), 0) AS vb, coalesce(covar_samp(a, b), 0) AS c FROM {rows} WHERE role = 'train' GROUP BY split, y),
{name}_p AS (SELECT split, sum(n)::DOUBLE AS total, sum((n - 1) * va) / greatest(1, sum(n) - count(*)) AS p11, sum((n - 1) * c) / greatest(1, sum(n) - count(*)) AS p12, sum((n - 1) * vb) / greatest(1, sum(n) - count(*)) AS p22 FROM {name}_m GROUP BY split),
{name}_i AS (SELECT *, sqrt(p11) AS sa, sqrt(p22) AS sb, coalesce(p12 / nullif(sqrt(p11) * sqrt(p22), 0), 0) AS rho FROM {name}_p),
{name}_v AS (SELECT split, total,
    CASE WHEN sa > 0 AND sb > 0 THEN CASE WHEN 1 - abs(rho) > 1e-10 * (1 + abs(rho)) THEN 1 / ((1 - rho * rho) * p11) ELSE 1 / (4 * p11) END WHEN sa > 0 THEN 1 / p11 ELSE 0 END AS i11,
    CASE WHEN sa > 0 AND sb > 0 THEN CASE WHEN 1 - abs(rho) > 1e-10 * (1 + abs(rho)) THEN -rho / ((1 - rho * rho) * sa * sb) ELSE sign(rho) / (4 * sa * sb) END ELSE 0 END AS i12,
    CASE WHEN sa > 0 AND sb > 0 THEN CASE WHEN 1 - abs(rho) > 1e-10 * (1 + abs(rho)) THEN 1 / ((1 - rho * rho) * p22) ELSE 1 / (4 * p22) END WHEN sb > 0 THEN 1 / p22 ELSE 0 END AS i22 FROM {name}_i),
{name}_w AS (SELECT m.split, y, n, total, ma, mb, ma * i11 + mb * i12 AS w1, ma * i12 + mb * i22 AS w2 FROM {name}_m m JOIN {name}_v v ON m.split = v.split),
{name}_s AS (SELECT t.split, subject_id, session_id, seq, t.y AS y_true, w.y AS cls, ln(n / total) - 0.5 * (w1 * ma + w2 * mb) + w1 * a + w2 * b AS s FROM {rows} t JOIN {name}_w w ON t.split = w.split WHERE role = 'test'),
{name}_t AS (SELECT *, max(s) OVER (PARTITION BY split, subject_id, session_id, seq) AS top FROM {name}_s),
{name} AS (SELECT split, subject_id, session_id, seq, y_true, min(cls) FILTER (s = top) AS y_pred, 1 / sum(exp(s - top)) AS confidence FROM {name}_t GROUP BY split, subject_id, session_id, seq, y_true)"""
