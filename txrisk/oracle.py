"""DuckDB SQL for the rows of the engine's queries."""

from __future__ import annotations

from txrisk.operators.ivf import MAX_CLUSTERS
from txrisk.operators.telemetry import BUCKETS, RING, SLOW_US
from txrisk.queries import CENTROID_EVERY, CONFIG, LOGISTIC
from txrisk.schema import DIMS, FEATURES

INTS = [f"q{d}" for d in range(DIMS)]
LIST = ", ".join(INTS)


def inv(x: float) -> str:
    return f"CAST(1.0::DOUBLE / {x}::DOUBLE AS FLOAT)"


def clamp(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN 0::FLOAT WHEN {x} > 1 THEN 1::FLOAT ELSE {x} END)"


def scaled(x: str, most: float) -> str:
    return clamp(f"(CAST({x} AS FLOAT) * {inv(most)})")


MINUTES = "(CAST(date_diff('second', date_trunc('second', last_ts), date_trunc('second', ts)) AS FLOAT) / 60::FLOAT)"
RISK = "(CASE event_type " + " ".join(f"WHEN '{e}' THEN {r}" for e, r in (("click", 0.15), ("view", 0.2), ("signup", 0.3), ("purchase", 0.45))) + " ELSE 0.5 END)::DOUBLE"
V = [
    scaled("value", 500),
    scaled("k % 12 + 1", 12),
    scaled("CASE WHEN usual > 0 THEN value / usual ELSE 0 END", 10),
    "CAST(hour(ts) AS FLOAT) / 23::FLOAT",
    "CAST(isodow(ts) - 1 AS FLOAT) / 6::FLOAT",
    f"CASE WHEN last_ts IS NULL THEN -1::FLOAT ELSE {clamp(f'({MINUTES} * {inv(1440)})')} END",
    f"CASE WHEN last_ts IS NULL THEN -1::FLOAT ELSE {scaled('abs(k - last_k) * 10', 1000)} END",
    scaled("k * 10", 1000),
    scaled("recent", 20),
    "CAST(event_type IN ('click', 'view') AS INT)::FLOAT",
    "CAST(event_id % 2 = 0 AS INT)::FLOAT",
    "CAST(visit = 1 AS INT)::FLOAT",
    f"CAST({RISK} AS FLOAT)",
    scaled("shop_usual", 500),
]

EVENTS = """e AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k,
         CAST(round(value * 100) AS BIGINT) AS cents FROM events),
w AS (
  SELECT *,
    coalesce(CAST(sum(cents) OVER u1 AS DOUBLE) / count(*) OVER u1 / 100.0::DOUBLE, 0) AS usual,
    count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) - 1 AS recent,
    lag(ts) OVER u AS last_ts, lag(k) OVER u AS last_k,
    row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS visit,
    coalesce(CAST(sum(cents) OVER s1 AS DOUBLE) / count(*) OVER s1 / 100.0::DOUBLE, 0) AS shop_usual
  FROM e WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id),
    u1 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    s1 AS (PARTITION BY k ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def quantized(x: str) -> str:
    return f"CAST(round(CAST(CAST({x} AS FLOAT) * 10000::FLOAT AS DOUBLE)) AS INT)"


FX = (
    f"WITH {EVENTS},\nf AS (SELECT *, event_type = 'error' AS is_fraud, "
    + ", ".join(f"{x} AS v{d}" for d, x in enumerate(V))
    + " FROM w),\nfx AS MATERIALIZED (SELECT *, "
    + ", ".join(f"{quantized(f'v{d}')} AS q{d}" for d in range(DIMS))
    + " FROM f)"
)


def distance(a: str, b: str, dims=INTS) -> str:
    return "(" + " + ".join(f"CAST({a}.{d} - {b}.{d} AS BIGINT) * ({a}.{d} - {b}.{d})" for d in dims) + ")"


SPLIT = f"""{FX},
qs AS MATERIALIZED (SELECT event_id AS qid, {LIST} FROM fx WHERE event_id % 20 = 0),
rs AS MATERIALIZED (SELECT event_id AS ref_id, {LIST}, is_fraud FROM fx)"""


def nearest(k: int) -> str:
    return f"""{SPLIT},
knn AS MATERIALIZED (SELECT * FROM (
  SELECT qid, ref_id, is_fraud, dist, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, ref_id) AS INT) AS rank
  FROM (SELECT qid, ref_id, is_fraud, {distance('qs', 'rs')} AS dist FROM qs JOIN rs ON qid <> ref_id)) WHERE rank <= {k})"""


FLOAT_DISTANCE = "(" + " + ".join(f"(q.v{d} - r.v{d}) * (q.v{d} - r.v{d})" for d in range(DIMS)) + ")"
EXACT = nearest(5) + """,
ev AS (SELECT qid, CAST(round(count_if(is_fraud) * 5 / count(*)) AS BIGINT) AS fraud FROM knn GROUP BY qid)"""

CLUSTERS = f"""{SPLIT},
cs AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY ref_id) - 1 AS INT) AS ci, {LIST} FROM (SELECT *, row_number() OVER (ORDER BY md5(CAST(ref_id AS VARCHAR))) AS turn,
    count(*) OVER () AS n_refs FROM rs) WHERE turn <= least({MAX_CLUSTERS}, ceil(n_refs / {CENTROID_EVERY}.0))),
al AS MATERIALIZED (SELECT * FROM (SELECT rs.*, cs.ci, {distance('rs', 'cs')} AS cdist,
    row_number() OVER (PARTITION BY ref_id ORDER BY {distance('rs', 'cs')}, cs.ci) AS o FROM rs CROSS JOIN cs) WHERE o = 1),
ms AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY ci ORDER BY ref_id) - 1 AS INT) AS pos FROM al),
pr AS MATERIALIZED (SELECT * FROM (SELECT qs.*, cs.ci, {distance('qs', 'cs')} AS cdist,
    CAST(row_number() OVER (PARTITION BY qid ORDER BY {distance('qs', 'cs')}, cs.ci) AS INT) AS probe FROM qs CROSS JOIN cs)),
sc AS MATERIALIZED (SELECT pr.qid, pr.probe, ms.pos, ms.ref_id, ms.is_fraud, {distance('pr', 'ms')} AS dist
  FROM pr JOIN ms USING (ci) WHERE pr.probe <= {CONFIG.nprobe} AND pr.qid <> ms.ref_id),
t1 AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, probe, pos) AS rank
  FROM sc WHERE probe <= {CONFIG.quick}) WHERE rank <= 5),
t2 AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, probe, pos) AS rank FROM sc) WHERE rank <= 5),
v1 AS (SELECT qid, count_if(is_fraud) AS fraud, sum(dist) AS dist, max(dist) AS worst FROM t1 GROUP BY qid),
v2 AS (SELECT qid, count_if(is_fraud) AS fraud FROM t2 GROUP BY qid),
tt AS (SELECT qs.qid, CAST(coalesce(CASE WHEN v1.fraud BETWEEN 2 AND 3 THEN v2.fraud ELSE v1.fraud END, 0) AS BIGINT) AS fraud
  FROM qs LEFT JOIN v1 USING (qid) LEFT JOIN v2 USING (qid))"""

def means(old: str, assigned: str) -> str:
    new = ", ".join(f"coalesce(CAST(sum(a.{q}) AS DOUBLE) / count(a.ref_id), any_value(o.{q})::DOUBLE) AS {q}" for q in INTS)
    return f"SELECT o.ci, count(a.ref_id) AS n, {new} FROM {old} o LEFT JOIN {assigned} a ON a.ci = o.ci GROUP BY o.ci"


def near(old: str) -> str:
    # Distances from norms and products would round in another order; ties of means are not to be expected.
    d = "(" + " + ".join(f"(rs.{q} - o.{q}) * (rs.{q} - o.{q})" for q in INTS) + ")"
    return f"SELECT * FROM (SELECT rs.*, o.ci, row_number() OVER (PARTITION BY ref_id ORDER BY round({d}, 3), o.ci) AS o FROM rs CROSS JOIN {old} o) WHERE o = 1"


MEANS = f"c1 AS MATERIALIZED ({means('cs', 'al')})"
AGAIN = f"a1 AS MATERIALIZED ({near('c1')}), c2 AS MATERIALIZED ({means('c1', 'a1')}), a2 AS MATERIALIZED ({near('c2')})"

BOXES = "SELECT ci, " + ", ".join(f"min({q}) AS lo_{q}" for q in INTS) + ", " + ", ".join(f"max({q}) AS hi_{q}" for q in INTS) + " FROM ms GROUP BY ci"
BOUND = " + ".join(f"CAST(greatest(b.lo_{q} - p.{q}, p.{q} - b.hi_{q}, 0) AS BIGINT) * greatest(b.lo_{q} - p.{q}, p.{q} - b.hi_{q}, 0)" for q in INTS)


def millionths(x: str) -> str:
    return f"CAST(round(({x}) * 1000000) AS BIGINT)"


def sigmoid(x: str) -> str:
    return f"(CASE WHEN {x} > 20 THEN 1.0::DOUBLE WHEN {x} < -20 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / (1.0::DOUBLE + exp(-({x}))) END)"


def _gbdt() -> str:
    f = lambda x: f"{x}::FLOAT"
    t1 = f"(CASE WHEN v0 <= {f(0.3)} THEN -0.8 ELSE CASE WHEN v12 <= {f(0.4)} THEN 0.1 ELSE 0.9 END END)::FLOAT"
    t2 = f"(CASE WHEN v7 <= {f(0.5)} THEN CASE WHEN v11 <= {f(0.5)} THEN -0.4 ELSE 0.2 END ELSE 0.6 END)::FLOAT"
    t3 = f"(CASE WHEN v5 <= {f(0.0)} THEN 0.3 ELSE CASE WHEN v8 <= {f(0.25)} THEN -0.2 ELSE 0.5 END END)::FLOAT"
    return f"{FX}, s AS (SELECT event_id, CAST({f(0.05)} + {t1} + {t2} + {t3} AS DOUBLE) AS x FROM fx) SELECT event_id, {millionths(f'CAST(CAST({sigmoid("x")} AS FLOAT) AS DOUBLE)')} AS score FROM s"


def _terms() -> list[str]:
    x = [f"({q} / 10000.0::DOUBLE)" for q in INTS]
    return [*x, *[f"({x[a]} * {x[b]})" for a in range(DIMS) for b in range(a, DIMS)]]


LOGREG = f"""{FX}, lx AS (SELECT event_id, is_fraud, {LOGISTIC.bias}::DOUBLE + {' + '.join(f'({w}::DOUBLE * {t})' for w, t in zip(LOGISTIC.weights, _terms()))} AS x FROM fx),
ls AS (SELECT event_id, is_fraud, {sigmoid('x')} AS p FROM lx)"""
CONFUSION = "SELECT count_if(p >= 0.5 AND is_fraud) AS tp, count_if(p < 0.5 AND NOT is_fraud) AS tn, count_if(p >= 0.5 AND NOT is_fraud) AS fp, count_if(p < 0.5 AND is_fraud) AS fn FROM ls"

LOG = """l AS (SELECT event_id AS seq, ts, CAST(round(value * 100) AS BIGINT) * 10 % 12000 AS latency_us,
  event_id % 6 AS fraud, event_id % 50 = 0 AS parse_error FROM events)"""


def _report() -> str:
    each = {
        "total": "true", "fraud": "NOT parse_error AND fraud >= 3", "legit": "NOT parse_error AND fraud < 3",
        "border_zone": "NOT parse_error AND fraud IN (2, 3)", "parse_errors": "parse_error", "http_errors": "false",
    }
    low = 0
    for b in BUCKETS:
        each[f"le_{b}"] = f"latency_us <= {b}" + (f" AND latency_us > {low}" if low else "")
        low = b
    each["overflow"] = f"latency_us > {low}"
    n = ", ".join(f"count_if({c}) AS {k}" for k, c in each.items())
    so_far = ", ".join(f"CAST(sum({k}) OVER w AS BIGINT) AS {k}" for k in each)
    return f"""WITH {LOG}, i AS (SELECT CAST(floor(epoch(ts) / 10) AS BIGINT) * 10 AS start, sum(latency_us) AS us, {n} FROM l GROUP BY 1)
SELECT start, total AS n, total / 10.0::DOUBLE AS rps, {so_far}, CAST(floor(CAST(sum(us) OVER w AS DOUBLE) / CAST(sum(total) OVER w AS DOUBLE)) AS BIGINT) AS mean_us
FROM i WINDOW w AS (ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def detection(fp: str, fn: str) -> str:
    e = f"({fp} + 3 * {fn} + 5 * errors)::DOUBLE"
    n = f"(tp + tn + {fp} + {fn} + errors)::DOUBLE"
    return f"(CASE WHEN ({fp} + {fn} + errors) / {n} > 0.15 THEN -3000.0::DOUBLE ELSE 1000 * log10(1 / greatest({e} / {n}, 0.001::DOUBLE)) - 300 * log10(1 + {e}) END)"


LATE = "(CASE WHEN p99 / 1000.0::DOUBLE > 2000 THEN -3000.0::DOUBLE ELSE 1000 * log10(1000 / greatest(p99 / 1000.0::DOUBLE, 1.0::DOUBLE)) END)"
LESS = detection("(fp // 100)", "(fn // 100)")

def _defaults() -> str:
    out = []
    for d, q in enumerate(INTS):
        zero = ["event_id % 6 = 0"]
        if d in (2, 8):
            zero.append("event_id % 6 = 1")
        if d in (11, 12, 13):
            zero += ["event_id % 6 = 1", "event_id % 6 = 2"]
        if d in (7, 9, 10):
            zero.append("event_id % 6 = 3")
        gone = " WHEN event_id % 6 = 4 THEN -10000" if d in (5, 6) else ""
        out.append(f"CASE WHEN {' OR '.join(zero)} THEN 0{gone} ELSE {q} END AS {q}")
    return f"{FX} SELECT event_id, {', '.join(out)} FROM fx"


FIRST_SECOND = "date_trunc('second', ts)"
DAY = "CAST(floor(epoch(ts) / 86400) AS BIGINT) * 86400"
SCORE = "SELECT qid, fraud, fraud < 3 AS approved, fraud / 5.0::DOUBLE AS fraud_score FROM ev"

ORACLE: dict[str, str] = {
    "fraud_score": f"{EXACT} {SCORE}",
    "features_quantized": f"{FX} SELECT event_id, {LIST}, is_fraud FROM fx",
    **{f"feat_{n}": f"{FX} SELECT event_id, q{d} AS q FROM fx" for d, n in enumerate(FEATURES)},
    "round4_amount": "SELECT event_id, round(value / 490.0::DOUBLE, 4) AS r4 FROM events",
    "clamp_amount": "WITH x AS (SELECT event_id, CAST((value - 100.0::DOUBLE) / 200.0::DOUBLE AS FLOAT) AS x FROM events) "
    f"SELECT event_id, {quantized(clamp('x'))} AS q FROM x",
    "mcc_lookup": f"{FX} SELECT event_id, {millionths(f'CASE WHEN event_id % 7 < 2 THEN 0.5 ELSE {RISK} END')} AS risk FROM fx",
    "parse_payload": f"""WITH {EVENTS} SELECT event_id, cents, CAST(k % 12 + 1 AS BIGINT) AS installments, CAST(recent AS BIGINT) AS recent,
  CAST(k AS VARCHAR) AS merchant, event_type IN ('click', 'view') AS is_online, event_id % 2 = 0 AS card_present,
  last_ts IS NULL AS is_first, CAST(visit = 1 AS INT) AS unknown FROM w""",
    "parse_civil_time": f"""SELECT event_id, CASE WHEN event_id % 3 <> 0 AND event_id % 11 = 1 THEN 0 ELSE CAST(hour(ts) AS INT) END AS hour,
  CASE WHEN event_id % 3 <> 0 AND event_id % 11 = 1 THEN 0 ELSE CAST(isodow(ts) - 1 AS INT) END AS weekday,
  CASE WHEN event_id % 3 <> 0 AND event_id % 11 = 1 THEN 0 ELSE CAST(epoch({FIRST_SECOND}) AS BIGINT) END AS epoch FROM events""",
    "invalid_gate": """SELECT event_id, event_id % 6 IN (0, 5) AS strict, event_id % 6 IN (0, 1, 5) AS loose, event_id % 6 = 0 AS valid,
  CASE WHEN event_id % 6 <> 0 THEN '{"approved":true,"fraud_score":0.0}' END AS fallback FROM events""",
    "missing_object_defaults": _defaults(),
    "knn_top5": f"{nearest(5)} SELECT qid, rank, ref_id, dist, is_fraud FROM knn",
    "knn_top5_native": f"{nearest(5)} SELECT qid, rank, ref_id, dist, is_fraud FROM knn",
    "knn_vote_ratio": f"{nearest(3)} SELECT qid, count(*) AS n, count_if(is_fraud) AS fraud, {millionths('count_if(is_fraud)::DOUBLE / count(*)')} AS ratio FROM knn GROUP BY qid",
    "knn_embeddings": """WITH x AS MATERIALIZED (SELECT vec_id, label = 1 AS is_fraud,
    list_transform(embedding, lambda v: CAST(greatest(-10000, least(10000, round(CAST(CAST(v * 10000::FLOAT AS FLOAT) AS DOUBLE)))) AS BIGINT)) AS e FROM embeddings),
  d AS (SELECT q.vec_id AS qid, r.vec_id AS ref_id, r.is_fraud, list_sum(list_transform(list_zip(q.e, r.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist
    FROM x q JOIN x r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0)
  SELECT * FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, ref_id) AS INT) AS rank, ref_id, CAST(dist AS BIGINT) AS dist, is_fraud FROM d) WHERE rank <= 5""",
    "knn_float": f"""{FX}, d AS (SELECT q.event_id AS qid, r.event_id AS ref_id, r.is_fraud, {FLOAT_DISTANCE} AS dist FROM fx q JOIN fx r ON q.event_id <> r.event_id WHERE q.event_id % 20 = 0)
SELECT * FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, ref_id) AS INT) AS rank, ref_id, CAST(dist AS DOUBLE) AS dist, is_fraud FROM d) WHERE rank <= 5""",
    "ref_counts": f"{SPLIT} SELECT count(*) AS n_refs, count_if(is_fraud) AS n_fraud, count_if(NOT is_fraud) AS n_legit FROM rs",
    "kmeans_assign": f"{CLUSTERS} SELECT ref_id, ci, cdist FROM al",
    "kmeans_update": f"{CLUSTERS}, {MEANS} SELECT * FROM c1",
    "kmeans_lloyd": f"{CLUSTERS}, {MEANS}, {AGAIN} SELECT ci, count(*) AS n FROM a2 GROUP BY ci",
    "inverted_lists": f"""{CLUSTERS}, n AS (SELECT ci, count(*) AS n FROM ms GROUP BY ci),
o AS (SELECT ci, n, CAST(coalesce(sum(n) OVER (ORDER BY ci ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM n)
SELECT ref_id, ci, pos, first, n FROM ms JOIN o USING (ci)""",
    "cluster_bbox": f"{CLUSTERS} {BOXES}",
    "centroid_distance": f"{CLUSTERS} SELECT qid, ci, cdist AS dist FROM pr",
    "probe_select": f"{CLUSTERS} SELECT qid, probe, ci FROM pr WHERE probe <= {CONFIG.nprobe}",
    "bbox_prune": f"""{CLUSTERS}, bx AS ({BOXES}),
lb AS (SELECT p.qid, p.ci, {BOUND} AS bound FROM pr p JOIN bx b USING (ci) WHERE p.probe <= {CONFIG.nprobe})
SELECT qid, ci, bound, bound < worst AS may_improve FROM lb JOIN v1 USING (qid)""",
    "ivf_quick": f"{CLUSTERS} SELECT qid, fraud, CAST(dist AS BIGINT) AS dist FROM v1",
    "ivf_two_tier": f"{CLUSTERS} SELECT qid, fraud FROM tt",
    "ivf_vs_exact": f"""{CLUSTERS}, k5 AS (SELECT qid, is_fraud, row_number() OVER (PARTITION BY qid ORDER BY dist, ref_id) AS o
  FROM (SELECT qid, ref_id, is_fraud, {distance('qs', 'rs')} AS dist FROM qs JOIN rs ON qid <> ref_id)),
ex AS (SELECT qid, count_if(is_fraud) AS exact FROM k5 WHERE o <= 5 GROUP BY qid)
SELECT count(*) AS n, count_if((fraud < 3) <> (exact < 3)) AS decisions_apart, count_if(fraud <> exact) AS votes_apart FROM tt JOIN ex USING (qid)""",
    "gbdt_predict": _gbdt(),
    "logreg_predict": f"{LOGREG} SELECT event_id, {millionths('p')} AS score FROM ls",
    "confusion_matrix": f"{LOGREG} {CONFUSION}",
    "decision_response": EXACT
    + """ SELECT qid, '{"approved":' || CASE WHEN fraud < 3 THEN 'true' ELSE 'false' END || ',"fraud_score":' || CAST(fraud / 5.0::DOUBLE AS VARCHAR) || '}' AS response FROM ev""",
    "telemetry_summary": f"""WITH {LOG} SELECT count(*) AS total, CAST(floor(sum(latency_us) / count(*)) AS BIGINT) AS mean_us, count_if(parse_error) AS parse_errors,
  count_if(NOT parse_error AND fraud >= 3) AS denied, count_if(NOT parse_error AND fraud < 3) AS approved, count_if(NOT parse_error AND fraud IN (2, 3)) AS border FROM l""",
    "latency_histogram": f"WITH {LOG} SELECT CASE {' '.join(f'WHEN latency_us <= {b} THEN {b}' for b in BUCKETS)} ELSE -1 END AS bucket_us, count(*) AS n FROM l GROUP BY 1",
    "outlier_ring": f"""WITH {LOG}, o AS (SELECT {DAY} AS start, seq, latency_us, CAST(row_number() OVER (PARTITION BY {DAY} ORDER BY seq DESC) AS INT) AS slot
  FROM l WHERE parse_error OR latency_us >= {SLOW_US} OR fraud IN (2, 3)) SELECT start, slot, seq, latency_us FROM o WHERE slot <= {RING}""",
    "rps_tumbling": _report(),
    "detection_score": f"""{LOGREG}, {LOG}, c AS ({CONFUSION}), p AS (SELECT quantile_cont(latency_us::DOUBLE, 0.99) AS p99, count_if(parse_error) AS errors FROM l)
SELECT tp, tn, fp // 100 AS fp, fn // 100 AS fn, errors, {millionths(LATE)} AS latency_points, {millionths(LESS)} AS detection_points,
  {millionths(detection('fp', 'fn'))} AS raw_points, {millionths(f'{LATE} + {LESS}')} AS final_points FROM c, p""",
}
