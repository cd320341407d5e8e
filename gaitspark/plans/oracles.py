"""DuckDB SQL for the queries of this folder; what SQL can't express (kernels, models) has tests instead."""

S = "SELECT user_id, event_id, (epoch_us(ts) - 1704067200000000) / 1e6 AS t, event_type, value FROM events"
GAPPY = f"SELECT user_id, event_id, t, CASE WHEN event_type <> 'error' THEN value END AS value FROM ({S})"
STATES = f"SELECT user_id, t, (value >= 20)::INT AS state FROM ({S})"
DAYS = """SELECT user_id, segment_name, (a * 86400)::DOUBLE AS start_time, (b * 86400)::DOUBLE AS end_time FROM (SELECT DISTINCT user_id FROM events),
  (VALUES ('outbound_walk', 0, 5), ('turn_1', 5, 8), ('return_walk', 8, 13), ('turn_to_sit', 13, 15), ('final_sitting', 15, 30)) AS d(segment_name, a, b)"""
BOUNDS = f"SELECT user_id, min(t) AS start_time, max(t) AS end_time FROM ({S}) GROUP BY user_id"
SCOPES = f"""SELECT user_id, 'trial' AS feature_level, 'full_trial' AS segment_name, start_time, end_time, true AS closed FROM ({BOUNDS})
  UNION ALL SELECT user_id, 'phase', segment_name, start_time, end_time, false FROM ({DAYS})"""
SAMPLES = f"SELECT user_id, t AS timestamp, value AS acc_ap, value - 10 AS acc_ml, sin(value) AS acc_vertical, cos(value) AS gyro_yaw FROM ({S})"
VECTORS = "SELECT label, vec_id, embedding[1]::DOUBLE AS qw, embedding[2]::DOUBLE AS qx, embedding[3]::DOUBLE AS qy, embedding[4]::DOUBLE AS qz FROM embeddings"


def gradient(y: str, t: str, window: str) -> str:
    """Second-order differences on an uneven grid, first-order at the ends."""
    y0, y2, t0, t2 = (f"{f}({x}) OVER {window}" for x in (y, t) for f in ("lag", "lead"))
    s, d = f"({t} - {t0})", f"({t2} - {t})"
    return f"""CASE WHEN {t0} IS NOT NULL AND {t2} IS NOT NULL
      THEN ({s}*{s}*{y2} + ({d}*{d} - {s}*{s})*{y} - {d}*{d}*{y0}) / nullif({s}*{d}*({s}+{d}), 0)
      WHEN {t2} IS NOT NULL THEN ({y2} - {y}) / nullif({d}, 0) WHEN {t0} IS NOT NULL THEN ({y} - {y0}) / nullif({s}, 0) END"""


def changed(name: str, source: str, rule: str) -> str:
    """CTEs that relabel runs of `state` in one pass; the rule sees state, n (the run's rows), run and last_run."""
    return f"""{name}_a AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(state) OVER w = state THEN 0 ELSE 1 END AS new FROM {source} WINDOW w AS (PARTITION BY user_id ORDER BY t)),
{name}_b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS run FROM {name}_a),
{name}_c AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS n, max(run) OVER (PARTITION BY user_id) AS last_run FROM {name}_b),
{name} AS (SELECT user_id, t, {rule} AS state FROM {name}_c)"""


def same_sign(name: str, source: str, order: str) -> str:
    """CTEs that flip each label's quaternions to the side of the one before; the result has the columns of source."""
    turned = ", ".join(f"v.{c} * s AS {c}" for c in ("qw", "qx", "qy", "qz"))
    return f"""{name}_n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {order}) AS n FROM {source}),
{name} AS (SELECT label, n, {order}, qw, qx, qy, qz FROM {name}_n WHERE n = 1 UNION ALL
  SELECT v.label, v.n, v.{order}, {turned} FROM {name} r JOIN {name}_n v ON v.label = r.label AND v.n = r.n + 1,
  LATERAL (SELECT CASE WHEN r.qw * v.qw + r.qx * v.qx + r.qy * v.qy + r.qz * v.qz < 0 THEN -1.0 ELSE 1.0 END::DOUBLE AS s))"""


BOTH = "CASE WHEN state = 1 AND n < 2 THEN 0 WHEN state = 0 AND run > 1 AND run < last_run AND n < 3 THEN 1 ELSE state END"
SPEECH = "CASE WHEN state = 1 AND n < 2 THEN 0 ELSE state END"
PAUSE = "CASE WHEN state = 0 AND run > 1 AND run < last_run AND n < 3 THEN 1 ELSE state END"
RUNS = f"""WITH s AS ({STATES}), a AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(state) OVER w = state THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t)::BIGINT AS run FROM a)
SELECT user_id, run, state::BIGINT AS state, min(t) AS first, max(t) AS last, count(*) AS n FROM b GROUP BY ALL"""
INTERVALS = f"SELECT user_id, first AS start_time, last + 600 AS end_time FROM ({RUNS}) WHERE state = 1"
SIDED = f"""SELECT user_id, CASE WHEN event_type IN ('click', 'view') THEN 'left' ELSE 'right' END AS side, t, (value >= 20)::INT AS state FROM ({S})"""
CONTACTS = f"""SELECT user_id, side, t, CASE WHEN state = 1 THEN 'contact' ELSE 'toe_off' END AS event
FROM (SELECT *, coalesce(lag(state) OVER (PARTITION BY user_id, side ORDER BY t), 0) AS before FROM ({SIDED})) WHERE state <> before"""
WAVE = f"SELECT user_id, list(value / 100 ORDER BY t) AS samples FROM ({S}) GROUP BY user_id"
MANIFEST = """SELECT o_orderkey AS row_number, CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE o_custkey::VARCHAR END AS participant_id, strftime(o_orderdate, '%Y-%m') AS session_id,
  o_orderpriority AS condition, o_orderstatus AS trial_id, o_totalprice > 100000 AS imu, o_totalprice > 200000 AS video, o_totalprice > 300000 AS audio,
  o_totalprice > 400000 AS footswitch, o_orderkey % 2 = 0 AS annotation, o_orderkey % 3 = 0 AS clinical FROM orders"""
MODALITIES = ("imu", "video", "audio", "footswitch", "annotation", "clinical")
FUSED = f"""SELECT c_custkey AS id, c_mktsegment AS condition, imu__total, imu__orders, (imu__orders IS NOT NULL)::BIGINT AS availability__imu,
  audio__mean_value, (audio__mean_value IS NOT NULL)::BIGINT AS availability__audio, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS clinical__balance, coalesce(c_acctbal > 0, false)::BIGINT AS availability__clinical
FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS imu__total, count(*) AS imu__orders FROM orders GROUP BY 1) ON c_custkey = o_custkey
LEFT JOIN (SELECT user_id, avg(value) AS audio__mean_value FROM ({S}) GROUP BY 1) ON c_custkey = user_id"""
POINTS = {"ls": 1, "rs": 3, "lh": 5, "rh": 7, "la": 9, "ra": 11}
SEEN = ", ".join(f"CASE WHEN abs(embedding[{i + 2}]::DOUBLE * 10) >= 0.2 THEN embedding[{i}]::DOUBLE END AS {p}_x, CASE WHEN abs(embedding[{i + 2}]::DOUBLE * 10) >= 0.2 THEN embedding[{i + 1}]::DOUBLE END AS {p}_y" for p, i in POINTS.items())
POSE = f"""SELECT label, vec_id, degrees(atan2((ls_x + rs_x) / 2 - (lh_x + rh_x) / 2, (lh_y + rh_y) / 2 - (ls_y + rs_y) / 2)) AS trunk_lean_degrees,
  CASE WHEN ls_x + rs_x + lh_x + rh_x IS NOT NULL THEN (lh_y + rh_y) / 2 END AS pelvis_center_y, abs(la_x - ra_x) AS left_right_step_length_proxy,
  abs(l - r) / nullif((l + r) / 2, 0) AS lower_limb_symmetry_proxy
FROM (SELECT *, sqrt((lh_x - la_x)^2 + (lh_y - la_y)^2) AS l, sqrt((rh_x - ra_x)^2 + (rh_y - ra_y)^2) AS r FROM (SELECT label, vec_id, {SEEN} FROM embeddings))"""
RANKS = lambda x: f"(rank() OVER (PARTITION BY g ORDER BY {x}) + (count(*) OVER (PARTITION BY g, {x}) - 1) / 2.0)"

#: Places of peaks: levels of equal samples that rise above both neighbours, at their middle; the highest (ties: the last)
#: of those nearer than `d` samples stays, in rounds; then the drop to the higher of the two lowest values beside it.
PEAKS = f"""WITH RECURSIVE x AS (SELECT user_id, t, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i FROM ({S})),
r AS (SELECT user_id, greatest(1, round_even(20000.0::DOUBLE * (1 / median(dt)), 0))::BIGINT AS d FROM (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS dt FROM x) WHERE dt > 0 GROUP BY user_id),
c AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY i) AS level FROM (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY user_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM x)),
l AS (SELECT user_id, level, any_value(v) AS v, (min(i) + max(i)) // 2 AS p FROM c GROUP BY user_id, level),
tops AS (SELECT user_id, p, v, d FROM (SELECT *, lag(v) OVER w AS before, lead(v) OVER w AS after FROM l WINDOW w AS (PARTITION BY user_id ORDER BY level)) JOIN r USING (user_id) WHERE v > before AND v > after),
m AS (SELECT a.user_id, a.p AS a, a.v AS va, b.p AS b, b.v AS vb, false AS taken FROM tops a JOIN tops b ON a.user_id = b.user_id AND abs(a.p - b.p) < a.d UNION ALL
  SELECT user_id, a, va, b, vb, da FROM (SELECT *, bool_or(db AND a <> b) OVER (PARTITION BY user_id, a) AS ga, bool_or(da AND a <> b) OVER (PARTITION BY user_id, b) AS gb FROM (
    SELECT *, bool_and(a = b OR va > vb OR va = vb AND a > b) OVER (PARTITION BY user_id, a) AS da, bool_and(a = b OR vb > va OR va = vb AND b > a) OVER (PARTITION BY user_id, b) AS db FROM m WHERE NOT taken))
  WHERE da AND a = b OR NOT (da OR db OR ga OR gb)),
k AS (SELECT user_id, a AS p, va AS v FROM m WHERE taken),
e AS (SELECT k.user_id, p, k.v, coalesce(max(i) FILTER (i < p AND x.v > k.v), -1) AS lo, coalesce(min(i) FILTER (i > p AND x.v > k.v), 9223372036854775807) AS hi FROM k JOIN x USING (user_id) GROUP BY k.user_id, p, k.v),
f AS (SELECT e.user_id, p, any_value(e.v) - greatest(min(x.v) FILTER (i > lo AND i <= p), min(x.v) FILTER (i >= p AND i < hi)) AS drop_ FROM e JOIN x USING (user_id) GROUP BY e.user_id, p)
SELECT user_id, round(t, 6) AS t FROM f JOIN x USING (user_id) WHERE i = p AND drop_ >= 5"""


def filtered(name: str, source: str) -> str:
    """CTEs of one run of two sections over source (user_id, k, x, and the coefficients), each from its steady state."""
    return f"""{name} AS (SELECT user_id, 0::BIGINT AS k, (b1 - a1 + b2 - a2) * x AS s1, (b2 - a2) * x AS s2, (d1 - c1 + d2 - c2) * x AS u1, (d2 - c2) * x AS u2, x AS y FROM {source} WHERE k = 1 UNION ALL
  SELECT user_id, n.k, b1 * n.x - a1 * w + s2, b2 * n.x - a2 * w, d1 * w - c1 * z + u2, d2 * w - c2 * z, z FROM {name} f JOIN {source} n USING (user_id),
  LATERAL (SELECT b0 * n.x + f.s1 AS w), LATERAL (SELECT d0 * w + f.u1 AS z) WHERE n.k = f.k + 1)"""


def section(pole: int, a: str, b: str) -> str:
    """Coefficients of a section: the pole at an angle on a circle of radius w, and the bilinear transform at 2 * rate = q."""
    angle = f"cos(pi() * {pole} / 8)"
    far, near = f"(q * q + 2 * q * w * {angle} + w * w)", f"(q * q - 2 * q * w * {angle} + w * w)"
    a1, a2 = f"(-2 * (q * q - w * w) / {near})", f"({far} / {near})"
    return f"{a1} AS {a}1, {a2} AS {a}2, (1 + {a1} + {a2}) / 4 AS {b}0, (1 + {a1} + {a2}) / 2 AS {b}1, (1 + {a1} + {a2}) / 4 AS {b}2"


LOWPASS = f"""WITH RECURSIVE x AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ({S})),
r AS (SELECT user_id, 1 / median(dt) AS rate FROM (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS dt FROM ({S})) WHERE dt > 0 GROUP BY user_id),
note AS (SELECT x.*, rate, CASE WHEN rate IS NULL THEN 'error: sampling rate is unknown' WHEN 1e-5::DOUBLE >= rate / 2 THEN 'error: cutoff is at or above half the sampling rate' WHEN n <= 15 THEN 'too short to filter' END AS filter_note FROM x LEFT JOIN r USING (user_id)),
co AS (SELECT user_id, {section(5, "a", "b")}, {section(7, "c", "d")} FROM (SELECT user_id, 2 * rate AS q, 2 * rate * tan(pi() * 1e-5::DOUBLE / rate) AS w FROM r)),
good AS (SELECT * FROM note WHERE filter_note IS NULL),
ext AS (SELECT user_id, i + 15 AS k, value AS x FROM good
  UNION ALL SELECT g.user_id, 17 - g.i, 2 * f.value - g.value FROM good g JOIN good f ON g.user_id = f.user_id AND f.i = 1 WHERE g.i BETWEEN 2 AND 16
  UNION ALL SELECT g.user_id, 2 * g.n - g.i + 15, 2 * f.value - g.value FROM good g JOIN good f ON g.user_id = f.user_id AND f.i = f.n WHERE g.i BETWEEN g.n - 15 AND g.n - 1),
there AS (SELECT * FROM ext JOIN co USING (user_id)), {filtered("forth", "there")},
turned AS (SELECT user_id, last_ + 1 - k AS k, y AS x FROM (SELECT *, max(k) OVER (PARTITION BY user_id) AS last_ FROM forth) WHERE k > 0),
home AS (SELECT * FROM turned JOIN co USING (user_id)), {filtered("back", "home")}
SELECT g.user_id, g.event_id, round(CASE WHEN g.filter_note IS NULL THEN y ELSE g.value END, 6) AS value, g.filter_note FROM note g LEFT JOIN back ON back.user_id = g.user_id AND back.k = g.n + 16 - g.i"""

SQL: dict[str, str] = {
    "step_peaks": PEAKS,
    "butterworth_lowpass": LOWPASS,
    "manifest_duplicates": "SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1",
    "manifest_issues": f"""WITH m AS ({MANIFEST}), ok AS (SELECT *, row_number() OVER (PARTITION BY participant_id, session_id, trial_id ORDER BY row_number) AS nth FROM m WHERE participant_id <> ''),
all_issues AS (SELECT row_number, 'error' AS severity, 'blank_id' AS code FROM m WHERE participant_id = ''
  UNION ALL SELECT row_number, 'error', 'condition' FROM ok WHERE condition NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')
  UNION ALL SELECT row_number, 'error', 'no_modality' FROM ok WHERE NOT (imu OR video OR audio OR footswitch OR annotation)
  UNION ALL SELECT row_number, 'error', 'duplicate' FROM ok WHERE nth > 1
  {" ".join(f"UNION ALL SELECT row_number, 'warning', 'absent' FROM ok WHERE NOT {m}" for m in MODALITIES)})
SELECT severity, code, count(*) AS n, sum(row_number)::BIGINT AS rows FROM all_issues GROUP BY ALL""",
    "modality_availability": " UNION ALL ".join(f"SELECT {i} AS place, '{m}' AS modality, count_if({m})::BIGINT AS available, count_if(NOT {m})::BIGINT AS missing FROM ({MANIFEST})" for i, m in enumerate(MODALITIES)),
    "unit_convert": f"SELECT event_id, round(value * 9.80665::DOUBLE - 9.80665::DOUBLE, 9) AS acc_vertical, round(radians(value), 9) AS gyro_yaw, round(t + 1.5::DOUBLE, 6) AS timestamp, round(20 * log10(greatest(value / 100, 2.2250738585072014e-308)), 9) AS dbfs FROM ({S})",
    "try_numeric": """WITH x AS (SELECT event_type, TRY_CAST(CASE WHEN event_type = 'error' THEN 'x' ELSE '' END || json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
SELECT event_type, count(k) AS n_valid, sum(k) AS total, count(*) - count(k) AS n_invalid FROM x GROUP BY event_type""",
    "sort_dedupe_first": """SELECT l_orderkey, strftime(l_shipdate, '%Y-%m-%d') AS ship, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_shipdate ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1""",
    "timestamp_quality": """SELECT user_id, count(*) AS n_samples, count(*) - count(DISTINCT value) AS n_duplicates, coalesce(bool_or(value < before), false) AS nonmonotonic
FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) GROUP BY user_id""",
    "missing_anomaly_ratio": f"SELECT user_id, round(avg((value IS NULL)::INT), 6) AS missing_ratio, round(avg(coalesce(abs(value) > 20, false)::INT), 6) AS anomaly_ratio FROM ({GAPPY}) GROUP BY user_id",
    "positional_interpolation": f"""WITH g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) AS n FROM ({GAPPY})), k AS (SELECT * FROM g WHERE value IS NOT NULL),
p AS (SELECT g.event_id, g.user_id, g.n, g.value, k.n AS pn, k.value AS pv FROM g ASOF LEFT JOIN k ON g.user_id = k.user_id AND g.n >= k.n),
q AS (SELECT p.*, k.n AS qn, k.value AS qv FROM p ASOF LEFT JOIN k ON p.user_id = k.user_id AND p.n <= k.n)
SELECT event_id, user_id, round(coalesce(value, pv + (qv - pv) * (n - pn) / nullif(qn - pn, 0), pv, qv), 6) AS value FROM q""",
    "sampling_rate": f"""WITH d AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS dt FROM ({S}))
SELECT user_id, round(1000 / median(dt), 6) AS sampling_rate_hz, round(stddev_samp(dt) / avg(dt) * 100, 6) AS interval_cv_pct FROM d WHERE dt > 0 GROUP BY user_id""",
    "linear_resample": f"""WITH s AS ({GAPPY}), b AS ({BOUNDS}), k AS (SELECT * FROM s WHERE value IS NOT NULL),
g AS (SELECT user_id, unnest(range(0, floor((end_time - start_time) / 21600 + 1e-9)::BIGINT + 1)) AS grid_index, start_time FROM b),
x AS (SELECT *, start_time + grid_index * 21600.0 AS g_t FROM g),
p AS (SELECT x.*, k.t AS pt, k.value AS pv FROM x ASOF LEFT JOIN k ON x.user_id = k.user_id AND x.g_t >= k.t),
q AS (SELECT p.*, k.t AS qt, k.value AS qv FROM p ASOF LEFT JOIN k ON p.user_id = k.user_id AND p.g_t < k.t)
SELECT user_id, grid_index, round(coalesce(pv + (qv - pv) * (g_t - pt) / (qt - pt), pv, qv), 6) AS value FROM q""",
    "gradient_rms": f"""WITH g AS (SELECT user_id, value, {gradient("value", "t / 3600", "(PARTITION BY user_id ORDER BY t)")} AS g FROM ({S}))
SELECT user_id, round(sqrt(avg(g * g)), 6) AS gradient_rms, round(sqrt(avg(value * value)), 6) AS value_rms FROM g GROUP BY user_id""",
    "quaternion_normalize": f"""SELECT vec_id, {", ".join(f"round({c} / nullif(sqrt(qw*qw + qx*qx + qy*qy + qz*qz), 0), 6) AS {c}" for c in ("qw", "qx", "qy", "qz"))} FROM ({VECTORS})""",
    "sign_continuity": f"""WITH RECURSIVE v AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM ({VECTORS})),
r AS (SELECT label, n, vec_id, qw, qx, qy, qz FROM v WHERE n = 1 UNION ALL
  SELECT v.label, v.n, v.vec_id, s * v.qw, s * v.qx, s * v.qy, s * v.qz FROM r JOIN v ON v.label = r.label AND v.n = r.n + 1,
  LATERAL (SELECT CASE WHEN r.qw * v.qw + r.qx * v.qx + r.qy * v.qy + r.qz * v.qz < 0 THEN -1.0 ELSE 1.0 END::DOUBLE AS s))
SELECT vec_id, round(qw, 6) AS qw, round(qx, 6) AS qx, round(qy, 6) AS qy, round(qz, 6) AS qz FROM r""",
    "slerp_resample": f"""WITH RECURSIVE unit AS (SELECT label, vec_id, {", ".join(f"{c} / sqrt(qw*qw + qx*qx + qy*qy + qz*qz) AS {c}" for c in ("qw", "qx", "qy", "qz"))} FROM ({VECTORS}) WHERE qw*qw + qx*qx + qy*qy + qz*qz > 0),
{same_sign("valid", "unit", "vec_id")}, k AS (SELECT label, vec_id::DOUBLE AS t, [qw, qx, qy, qz] AS q FROM valid),
b AS (SELECT label, min(vec_id)::DOUBLE AS a, max(vec_id)::DOUBLE AS z FROM embeddings GROUP BY label),
g AS (SELECT label, unnest(range(0, floor((z - a) * 0.1 + 1e-9)::BIGINT + 1)) AS grid_index, a FROM b), x AS (SELECT label, grid_index, a + grid_index * 10.0 AS t FROM g),
p AS (SELECT x.*, k.t AS pt, k.q AS p FROM x ASOF LEFT JOIN k ON x.label = k.label AND x.t >= k.t), pq AS (SELECT p.*, k.t AS qt, k.q AS q FROM p ASOF LEFT JOIN k ON p.label = k.label AND p.t < k.t),
u AS (SELECT *, (t - pt) / (qt - pt) AS u, acos(greatest(-1, least(1, list_dot_product(p, q)))) AS w FROM pq),
s AS (SELECT *, CASE WHEN sin(w) < 1e-9 THEN 1 - u ELSE sin((1 - u) * w) / sin(w) END AS c, CASE WHEN sin(w) < 1e-9 THEN u ELSE sin(u * w) / sin(w) END AS d FROM u),
mixed AS (SELECT label, grid_index, {", ".join(f"coalesce(p[{i}] * c + q[{i}] * d, p[{i}], q[{i}]) AS {n}" for i, n in enumerate(("qw", "qx", "qy", "qz"), 1))} FROM s), {same_sign("even", "mixed", "grid_index")}
SELECT label, grid_index, round(qw, 6) AS qw, round(qx, 6) AS qx, round(qy, 6) AS qy, round(qz, 6) AS qz FROM even""",
    # the closest pair of an event that is also the closest of its partner is taken, in rounds: the same as closest first
    "event_match": f"""WITH RECURSIVE e AS (SELECT user_id, event_type, t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t) AS n FROM ({S})),
near AS (SELECT f.user_id, f.n AS i, r.n AS r, abs(f.t - r.t) AS error FROM e f JOIN e r ON f.user_id = r.user_id AND f.event_type = 'click' AND r.event_type = 'view' AND abs(f.t - r.t) <= 20000),
m AS (SELECT *, false AS taken FROM near UNION ALL
  SELECT user_id, i, r, error, taken FROM (SELECT *, bool_or(taken) OVER (PARTITION BY user_id, i) OR bool_or(taken) OVER (PARTITION BY user_id, r) AS used FROM (
    SELECT user_id, i, r, error, row_number() OVER (PARTITION BY user_id, i ORDER BY error, i, r) = 1 AND row_number() OVER (PARTITION BY user_id, r ORDER BY error, i, r) = 1 AS taken FROM m WHERE NOT taken)) WHERE taken OR NOT used),
k AS (SELECT user_id, count(*) AS m, avg(error) AS err FROM m WHERE taken GROUP BY user_id),
c AS (SELECT user_id, nullif(count_if(event_type = 'click'), 0) AS f, nullif(count_if(event_type = 'view'), 0) AS r FROM e GROUP BY user_id)
SELECT user_id, coalesce(m, 0) AS matched_event_count, round(coalesce(m, 0) / f, 6) AS event_precision, round(coalesce(m, 0) / r, 6) AS event_recall, round(err, 6) AS event_mean_abs_error_s,
  round(CASE WHEN m > 0 THEN 2 * (m / f) * (m / r) / (m / f + m / r) END, 6) AS event_agreement_f1 FROM c LEFT JOIN k USING (user_id)""",
    # every source is large enough to be dealt by itself
    "group_folds": """WITH RECURSIVE s AS (SELECT source, count_if(quality = 0) AS a, count_if(quality = 1) AS b FROM labels JOIN documents USING (doc_id) GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY greatest(a, b) DESC, a + b DESC, source) AS n FROM s), whole AS (SELECT nullif(sum(a), 0)::BIGINT AS ta, nullif(sum(b), 0)::BIGINT AS tb FROM s),
g AS (SELECT 0::BIGINT AS n, NULL::VARCHAR AS source, NULL::BIGINT AS fold, [0, 0, 0]::BIGINT[] AS la, [0, 0, 0]::BIGINT[] AS lb UNION ALL
  SELECT o.n, o.source, k, [la[i] + CASE WHEN i = k + 1 THEN a ELSE 0 END FOR i IN [1, 2, 3]]::BIGINT[], [lb[i] + CASE WHEN i = k + 1 THEN b ELSE 0 END FOR i IN [1, 2, 3]]::BIGINT[]
  FROM g JOIN o ON o.n = g.n + 1, whole,
  LATERAL (SELECT list_sort([{'c': greatest(coalesce((la[i] + a) / ta, 0), coalesce((lb[i] + b) / tb, 0)), 's': la[i] + lb[i], 'k': i - 1} FOR i IN [1, 2, 3]])[1].k::BIGINT AS k))
SELECT source, fold FROM g WHERE n > 0""",
    "step_statistics": f"""WITH p AS (SELECT user_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS gap FROM ({S}) WHERE event_type = 'purchase'),
a AS (SELECT user_id, count(*) AS n, avg(gap) AS m, stddev_samp(gap) AS sd FROM p GROUP BY user_id)
SELECT b.user_id, round(m, 4) AS imu__mean_step_time_s, round(sd, 4) AS imu__step_time_sd_s, round(sd / m * 100, 4) AS imu__step_time_cv_pct, coalesce(n, 0) AS imu__step_count,
  round(coalesce(n, 0) / (end_time - start_time) * 60, 4) AS imu__cadence_steps_min FROM ({BOUNDS}) b LEFT JOIN a USING (user_id)""",
    "value_runs": f"SELECT user_id, run, state, round(first, 6) AS first, round(last, 6) AS last, n FROM ({RUNS})",
    "debounce": f"WITH s AS ({STATES}), {changed('one', 's', BOTH)}, {changed('two', 'one', BOTH)} SELECT user_id, round(t, 6) AS t, state::BIGINT AS state FROM two",
    "vad_stabilize": f"WITH s AS ({STATES}), {changed('one', 's', SPEECH)}, {changed('two', 'one', PAUSE)} SELECT user_id, round(t, 6) AS t, state::BIGINT AS state FROM two",
    "contact_events": f"SELECT user_id, side, round(t, 6) AS t, event FROM ({CONTACTS})",
    "contact_timing": f"""WITH e AS (SELECT c.* FROM ({CONTACTS}) c JOIN ({BOUNDS}) b ON c.user_id = b.user_id AND c.t >= b.start_time AND c.t < b.end_time),
g AS (SELECT *, t - lag(t) OVER s AS gap, lag(event) OVER s AS before, CASE WHEN event = 'contact' THEN t - lag(t) OVER (PARTITION BY user_id, event ORDER BY t, side) END AS step FROM e WINDOW s AS (PARTITION BY user_id, side ORDER BY t)),
a AS (SELECT user_id, count_if(event = 'contact' AND side = 'left')::BIGINT AS l, count_if(event = 'contact' AND side = 'right')::BIGINT AS r,
  avg(gap) FILTER (event = 'toe_off' AND side = 'left' AND before = 'contact') AS ls, avg(gap) FILTER (event = 'toe_off' AND side = 'right' AND before = 'contact') AS rs,
  avg(gap) FILTER (event = 'contact' AND side = 'left' AND before = 'toe_off') AS lw, avg(gap) FILTER (event = 'contact' AND side = 'right' AND before = 'toe_off') AS rw, avg(step) AS m, stddev_samp(step) AS sd FROM g GROUP BY user_id)
SELECT user_id, l AS left_contact_count, r AS right_contact_count, l + r AS step_count, round(ls, 4) AS mean_left_stance_time_s, round(rs, 4) AS mean_right_stance_time_s, round(lw, 4) AS mean_left_swing_time_s,
  round(rw, 4) AS mean_right_swing_time_s, round(m, 4) AS mean_step_time_s, round(sd, 4) AS step_time_sd_s, round(abs(ls - rs) / nullif((ls + rs) / 2, 0) * 100, 4) AS stance_time_asymmetry_pct, round(sd / m * 100, 4) AS step_time_cv_pct FROM a""",
    "frame_rms": f"""WITH w AS (SELECT user_id, samples, len(samples) AS n FROM ({WAVE})), f AS (SELECT *, unnest(range(0, ((n + 7) // 8)::BIGINT)) AS frame FROM w),
r AS (SELECT *, sqrt(list_sum(list_transform(samples[frame * 8 + 1 : frame * 8 + 8], lambda x: x * x)) / 8) AS rms FROM f)
SELECT user_id, frame, round(frame * 8 / 1000, 6)::DOUBLE AS start_time, round(least((frame + 1) * 8 / 1000, n / 1000), 6)::DOUBLE AS end_time, round(rms, 6) AS rms, (rms >= pow(10, -15 / 20.0))::BIGINT AS is_speech FROM r""",
    "clipping_ratio": f"SELECT user_id, round(avg((abs(value / 100) >= 0.3)::INT), 6) AS clipping_ratio FROM ({S}) GROUP BY user_id",
    "interval_clip": f"""SELECT d.user_id, segment_name, round(greatest(i.start_time, d.start_time), 6) AS clip_start, round(least(i.end_time, d.end_time), 6) AS clip_end
FROM ({DAYS}) d JOIN ({INTERVALS}) i ON d.user_id = i.user_id AND i.start_time < d.end_time AND i.end_time > d.start_time""",
    "speech_features": f"""WITH w AS ({SCOPES}), c AS (SELECT w.user_id, feature_level, segment_name, greatest(i.start_time, w.start_time) AS a, least(i.end_time, w.end_time) AS b
  FROM w JOIN ({INTERVALS}) i ON w.user_id = i.user_id AND i.start_time < w.end_time AND i.end_time > w.start_time),
p AS (SELECT *, a - lag(b) OVER (PARTITION BY user_id, feature_level, segment_name ORDER BY a, b) AS pause FROM c),
g AS (SELECT user_id, feature_level, segment_name, count(*) AS n, sum(b - a) AS s, count_if(pause >= 3600)::BIGINT AS np, avg(pause) FILTER (pause >= 3600) AS mp, max(pause) FILTER (pause >= 3600) AS xp, min(a) FILTER (a >= 10000) AS f FROM p GROUP BY ALL)
SELECT w.user_id, feature_level, segment_name, coalesce(n, 0) AS audio__speech_segment_count, round(coalesce(s, 0), 4) AS audio__speech_duration_s, round(greatest(0, end_time - start_time - coalesce(s, 0)), 4) AS audio__silence_duration_s,
  round(coalesce(s, 0) / (end_time - start_time), 4) AS audio__speech_ratio, coalesce(np, 0) AS audio__pause_count, round(mp, 4) AS audio__mean_pause_duration_s, round(xp, 4) AS audio__max_pause_duration_s,
  round(CASE WHEN feature_level = 'trial' THEN f - 10000 END, 4) AS audio__first_response_latency_s FROM w LEFT JOIN g USING (user_id, feature_level, segment_name)""",
    "segment_slice": f"""SELECT d.user_id, segment_name, count(*) AS n, round(avg(value), 6) AS mean_value, round(min(t), 6) AS first_t FROM ({S}) s JOIN ({DAYS}) d ON s.user_id = d.user_id AND t >= start_time AND t < end_time GROUP BY ALL""",
    "phase_features": f"""WITH i AS (SELECT w.*, s.* EXCLUDE user_id FROM ({SAMPLES}) s JOIN ({SCOPES}) w ON s.user_id = w.user_id AND timestamp >= start_time AND (timestamp < end_time OR closed AND timestamp = end_time)),
j AS (SELECT *, {", ".join(f"{gradient(c, 'timestamp', '(PARTITION BY user_id, feature_level, segment_name ORDER BY timestamp)')} AS j_{c}" for c in ("acc_ap", "acc_ml", "acc_vertical"))},
  timestamp - lag(timestamp) OVER (PARTITION BY user_id, feature_level, segment_name ORDER BY timestamp) AS dt FROM i)
SELECT user_id, feature_level, segment_name, count(*) AS imu__sample_count, round(any_value(end_time - start_time), 4) AS imu__duration_s, round(sqrt(avg(acc_ap^2)), 4) AS imu__pelvis_acc_rms_ap_m_s2, round(sqrt(avg(acc_ml^2)), 4) AS imu__pelvis_acc_rms_ml_m_s2,
  round(sqrt(avg(acc_vertical^2)), 4) AS imu__pelvis_acc_rms_vertical_m_s2, round(max(acc_ml) - min(acc_ml), 4) AS imu__pelvis_acc_range_ml_m_s2, round(sqrt(avg(j_acc_ap^2 + j_acc_ml^2 + j_acc_vertical^2)) * 1e6, 4) AS imu__pelvis_jerk_rms_m_s3,
  round(sqrt(avg(gyro_yaw^2)), 4) AS imu__angular_velocity_rms_rad_s, round(1 / median(dt) FILTER (dt > 0) * 1e6, 4) AS imu__sampling_rate_hz FROM j GROUP BY ALL""",
    "turn_features": f"""WITH d AS (SELECT *, 'phase' AS feature_level FROM ({DAYS}) WHERE starts_with(segment_name, 'turn')), w AS (SELECT * FROM d UNION ALL SELECT user_id, 'full_trial', start_time, end_time, 'trial' FROM d),
i AS (SELECT w.*, s.* EXCLUDE user_id FROM ({SAMPLES}) s JOIN w ON s.user_id = w.user_id AND timestamp >= start_time AND timestamp < end_time),
g AS (SELECT *, {gradient("gyro_yaw", "timestamp", "(PARTITION BY user_id, feature_level, segment_name ORDER BY start_time, timestamp)")} AS g FROM i),
a AS (SELECT user_id, feature_level, segment_name, max(abs(gyro_yaw)) AS p, avg(abs(gyro_yaw)) AS m, sqrt(avg(g * g)) AS s FROM g GROUP BY ALL), u AS (SELECT user_id, feature_level, segment_name, sum(end_time - start_time) AS dur FROM w GROUP BY ALL)
SELECT user_id, feature_level, segment_name, round(dur, 4) AS imu__turn_duration_s, round(p, 4) AS imu__peak_yaw_velocity_rad_s, round(m, 4) AS imu__mean_abs_yaw_velocity_rad_s, round(s * 1e6, 4) AS imu__turn_smoothness_rad_s2 FROM u LEFT JOIN a USING (user_id, feature_level, segment_name)""",
    "alignment_qc": """WITH r AS (SELECT o_custkey, min(date_diff('day', DATE '1990-01-01', o_orderdate::DATE))::DOUBLE AS r0, max(date_diff('day', DATE '1990-01-01', o_orderdate::DATE))::DOUBLE AS r1 FROM orders GROUP BY 1),
g AS (SELECT o_custkey, min(date_diff('day', DATE '1990-01-01', l_shipdate::DATE))::DOUBLE AS t0, max(date_diff('day', DATE '1990-01-01', l_shipdate::DATE))::DOUBLE AS t1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
a AS (SELECT *, CASE WHEN o_custkey % 2 = 0 THEN -1500.0 ELSE 100.0 END AS f, o_custkey % 5 = 0 AS unknown FROM r JOIN g USING (o_custkey)),
b AS (SELECT *, greatest(0.0, least(r1, t1 + f) - greatest(r0, t0 + f))::DOUBLE AS ov, least(r1 - r0, t1 - t0) AS short, abs((t1 - t0) - (r1 - r0)) AS dd FROM a),
c AS (SELECT *, CASE WHEN short > 0 THEN ov / short ELSE 0.0 END AS ratio FROM b)
SELECT o_custkey, round(ov, 6) AS overlap_s, round(ratio, 6) AS overlap_ratio, round(dd, 6) AS duration_difference_s, CASE WHEN ov <= 0 THEN 'fail' WHEN ratio < 0.9 OR dd > 200 OR unknown THEN 'warning' ELSE 'pass' END AS qc_status,
  (CASE WHEN ov <= 0 THEN 1 ELSE (ratio < 0.9)::INT + (dd > 200)::INT END + unknown::INT)::BIGINT AS n_notes FROM c""",
    "timeline_extents": """WITH x AS (SELECT l_orderkey, date_diff('day', DATE '1990-01-01', l_shipdate::DATE)::DOUBLE AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem),
y AS (SELECT *, d - lag(d) OVER (PARTITION BY l_orderkey ORDER BY n) AS step FROM x), z AS (SELECT l_orderkey, arg_min(d, n) AS a, arg_max(d, n) AS b, count(*) AS k, count_if(step < 0) AS falling FROM y GROUP BY 1)
SELECT l_orderkey, a AS start_time, b AS end_time, CASE WHEN k < 2 THEN 'at least two timestamps are required' WHEN falling > 0 THEN 'timestamps decrease' WHEN b <= a THEN 'duration is zero' END AS error FROM z""",
    "pose_metrics": f"""SELECT vec_id AS frame_index, round(trunk_lean_degrees, 6) AS trunk_lean_degrees, round(pelvis_center_y, 6) AS pelvis_center_y, round(left_right_step_length_proxy, 6) AS left_right_step_length_proxy,
  round(lower_limb_symmetry_proxy, 6) AS lower_limb_symmetry_proxy FROM ({POSE})""",
    "pose_summary": f"""WITH f AS (SELECT p.*, vec_id % 7 <> 0 AS detected FROM ({POSE}) p), c AS (SELECT vec_id, avg(abs(embedding[i + 2]::DOUBLE * 10)) AS v FROM embeddings, (VALUES (1), (3), (5), (7), (9), (11)) AS k(i) GROUP BY 1),
w AS (SELECT DISTINCT label, 'trial' AS feature_level, 'trial' AS segment_name, 0.0 AS a, 100.0 AS b FROM embeddings UNION ALL SELECT DISTINCT label, 'phase', 'sit_to_stand', 10.0, 300.0 FROM embeddings),
g AS (SELECT w.label, feature_level, segment_name, count(vec_id) AS n, count_if(coalesce(detected, false))::BIGINT AS d, avg(v) AS conf, avg(trunk_lean_degrees) AS m, max(trunk_lean_degrees) - min(trunk_lean_degrees) AS r, max(pelvis_center_y) - min(pelvis_center_y) AS pv,
  max(abs(trunk_lean_degrees)) AS fx, avg(left_right_step_length_proxy) AS st, avg(lower_limb_symmetry_proxy) AS sy FROM w LEFT JOIN (SELECT * FROM f JOIN c USING (vec_id)) f ON w.label = f.label AND vec_id >= a AND vec_id < b GROUP BY ALL)
SELECT label::BIGINT AS label, feature_level, segment_name, n AS video__processed_frame_count, d AS video__detected_frame_count, round(conf, 6) AS video__mean_landmark_confidence, round(m, 6) AS video__trunk_lean_mean_degrees, round(r, 6) AS video__trunk_lean_range_degrees,
  round(pv, 6) AS video__pelvis_vertical_displacement_proxy, round(st, 6) AS video__left_right_step_length_proxy, round(sy, 6) AS video__lower_limb_symmetry_proxy,
  round(max(CASE WHEN segment_name = 'sit_to_stand' THEN fx END) OVER (PARTITION BY label), 6) AS video__sit_to_stand_trunk_flexion_degrees, round(d / nullif(n, 0), 6) AS video__pose_detection_rate FROM g""",
    "probe_metadata": """WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 12.5 ELSE p_size / 2.0 END::DOUBLE AS d, CASE WHEN p_partkey % 4 = 0 THEN 25.0 ELSE 30000 / 1001.0 END::DOUBLE AS f, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS nb FROM part)
SELECT p_partkey, round(d, 6) AS duration_s, round(f, 6) AS frame_rate_hz, coalesce(nb, round_even(d * f, 0))::BIGINT AS total_frames, nb IS NULL AS frames_estimated, NULL::VARCHAR AS error FROM x""",
    "fuse_left": f"SELECT * REPLACE (round(imu__total, 2) AS imu__total, round(audio__mean_value, 2) AS audio__mean_value, round(clinical__balance, 2) AS clinical__balance) FROM ({FUSED})",
    "feature_inventory": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{c.split('__')[1] if c.startswith('availability') else c.split('__')[0]}' AS modality, '{'availability' if c.startswith('availability') else 'feature_or_target'}' AS role, count({c}) AS observed_count, count(*) - count({c}) AS missing_count FROM ({FUSED})"
        for c in ("imu__total", "imu__orders", "availability__imu", "audio__mean_value", "availability__audio", "clinical__balance", "availability__clinical")
    ),
    "clinical_union_dedupe": """SELECT DISTINCT n::VARCHAR AS participant_id, (n % 5)::BIGINT AS clinical__group, 1::BIGINT AS availability__clinical FROM (SELECT s_nationkey AS n FROM supplier UNION ALL SELECT c_nationkey FROM customer)""",
    "dual_task_cost": """WITH o AS (SELECT o_custkey AS participant_id, o_orderpriority AS condition, max(o_orderkey) AS trial_id, avg(o_totalprice) AS p, count(*)::DOUBLE AS k FROM orders GROUP BY ALL)
SELECT s.participant_id, s.trial_id AS single_trial_id, d.trial_id AS dual_trial_id, round(s.p, 4) AS single__imu_mean_price, round(d.p, 4) AS dual__imu_mean_price, round((d.p - s.p) / abs(s.p) * 100, 4) AS dtc__imu_mean_price_pct,
  s.k AS single__audio_orders_pct, d.k AS dual__audio_orders_pct, round((s.k - d.k) / abs(s.k) * 100, 4) AS dtc__audio_orders_pct, 2::BIGINT AS dtc_valid_metric_count
FROM o s JOIN o d ON s.participant_id = d.participant_id AND s.condition = '1-URGENT' AND d.condition = '5-LOW'""",
    "cohort_filter": f"SELECT condition, count(*) AS n FROM ({FUSED}) WHERE clinical__balance IS NOT NULL AND availability__imu = 1 AND availability__audio = 1 GROUP BY condition",
    "split_audit": """WITH k AS (SELECT DISTINCT c_nationkey, c_nationkey % 4 AS f FROM customer)
SELECT fold::BIGINT AS fold, count_if(f <> fold)::BIGINT AS train_group_count, count_if(f = fold)::BIGINT AS test_group_count, 0::BIGINT AS group_overlap_count FROM k, range(4) AS r(fold) GROUP BY fold""",
    "median_impute": f"SELECT event_id, round(coalesce(value, (SELECT median(value) FROM ({GAPPY}))), 6) AS value FROM ({GAPPY})",
    "standard_scale": """SELECT p_partkey, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 6) AS price,
  round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part), 6) AS size, 0.0::DOUBLE AS constant FROM part""",
    "regression_metrics": f"""WITH x AS (SELECT p_brand AS g, p_retailprice AS y, p_size * 20.0 + 900 AS p FROM part), r AS (SELECT *, {RANKS("y")} AS ry, {RANKS("p")} AS rp FROM x)
SELECT g AS p_brand, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p)^2)), 4) AS rmse, round(1 - sum((y - p)^2) / nullif(var_pop(y) * count(*), 0), 4) AS r2, round(corr(ry, rp), 4) AS spearman FROM r GROUP BY g""",
    "classification_metrics": f"""WITH x AS (SELECT source AS g, quality AS y, (n_chars % 101 / 101 > 0.4)::INT AS p, n_chars % 101 / 101 AS s FROM labels JOIN documents USING (doc_id)), r AS (SELECT *, {RANKS("s")} AS k FROM x),
c AS (SELECT g, count_if(y = 1 AND p = 1)::DOUBLE AS tp, count_if(y = 0 AND p = 1)::DOUBLE AS fp, count_if(y = 0 AND p = 0)::DOUBLE AS tn, count_if(y = 1 AND p = 0)::DOUBLE AS fn, sum(k) FILTER (y = 1) AS su FROM r GROUP BY g)
SELECT g AS source, round(list_avg(list_filter([tp / nullif(tp + fn, 0), tn / nullif(tn + fp, 0)], lambda x: x IS NOT NULL)), 6) AS balanced_accuracy, round((su - (tp + fn) * (tp + fn + 1) / 2) / nullif((tp + fn) * (tn + fp), 0), 6) AS roc_auc,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS sensitivity,
  round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity FROM c""",
    "fold_summary": """WITH f AS (SELECT o_orderpriority, o_orderkey % 5 AS fold, avg(o_totalprice) AS mae, max(o_totalprice) FILTER (o_orderkey % 5 > 1) AS r2 FROM orders GROUP BY ALL), l AS (SELECT o_orderpriority, 'mae' AS metric, mae AS v FROM f UNION ALL SELECT o_orderpriority, 'r2', r2 FROM f)
SELECT o_orderpriority, metric, round(avg(v), 3) AS mean, round(stddev_samp(v), 3) AS sd, count(v) AS valid_folds FROM l GROUP BY ALL""",
    "qc_status_counts": "SELECT o_orderpriority, count(*) AS n_rows, count_if(o_orderstatus = 'O')::BIGINT AS n_pass, count_if(o_orderstatus NOT IN ('F', 'O'))::BIGINT AS n_warning, count_if(o_orderstatus = 'F')::BIGINT AS n_fail FROM orders GROUP BY 1",
    "report_counts": "SELECT count(*) AS n_rows, count_if(o_orderkey % 8 = 0)::BIGINT AS n_trial, count_if(o_orderkey % 8 <> 0)::BIGINT AS n_phase, count(DISTINCT o_custkey) AS participants, count(DISTINCT o_orderpriority) AS conditions FROM orders",
    "fused_user_features": f"""WITH s AS ({S}), g AS (SELECT user_id, {gradient("value", "t / 3600", "(PARTITION BY user_id ORDER BY t)")} AS g FROM s), a AS (SELECT user_id, count(*) AS n_samples, round(sqrt(avg(g * g)), 4) AS gradient_rms FROM g GROUP BY 1),
d AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS dt FROM s), r AS (SELECT user_id, round(1000 / median(dt), 4) AS sampling_rate_hz, round(stddev_samp(dt) / avg(dt) * 100, 4) AS interval_cv_pct FROM d WHERE dt > 0 GROUP BY 1),
p AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS gap FROM s WHERE event_type = 'purchase'), q AS (SELECT user_id, count(*) AS n, round(avg(gap), 4) AS m FROM p GROUP BY 1)
SELECT a.user_id, n_samples, gradient_rms, sampling_rate_hz, interval_cv_pct, coalesce(q.n, 0) AS imu__step_count, m AS imu__mean_step_time_s, (a.user_id IN (SELECT user_id FROM s WHERE event_type = 'error'))::BIGINT AS availability__error
FROM a LEFT JOIN r USING (user_id) LEFT JOIN q USING (user_id)""",
}
