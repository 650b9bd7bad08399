"""DuckDB SQL of the registered queries, written from their definitions and independent of the Spark code."""

from __future__ import annotations

PADS = ("click", "error", "purchase", "signup", "view")
LEVELS = (1, 3, 4, 5)
FRAMES = """fr AS (
  SELECT user_id AS recording_id, CAST(user_id % 7 AS INTEGER) AS label, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS t,
    least(value / 100, CAST(1 AS DOUBLE)) AS x, event_type AS pad, CAST(json_extract_string(props, '$.k') AS INTEGER) % 6 - 1 AS z,
    CAST(json_extract_string(props, '$.k') AS INTEGER) * 20 AS r
  FROM events),
n AS (SELECT recording_id, any_value(label) AS label, count(*) AS n FROM fr GROUP BY 1)"""


def r6(x: str) -> str:
    return f"round({x} + 1e-12, 6)"


def z(p: str) -> str:
    return f"CASE WHEN pad = '{p}' THEN z ELSE -1 END"


def r(p: str) -> str:
    return f"CASE WHEN pad = '{p}' THEN r ELSE 0 END"


def bin_of(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN 0 WHEN {x} < 900 THEN 1 ELSE 2 END"


SMOOTHED = FRAMES.replace("fr AS", "plain AS", 1).replace("FROM fr GROUP", "FROM plain GROUP") + """,
fr AS (SELECT recording_id, label, t, avg(x) OVER (PARTITION BY recording_id ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS x, pad, z, r FROM plain)"""


def windows(width: str, frames: str = FRAMES) -> str:
    """wf: frames of sliding windows; width is a number or a query."""
    return f"""WITH {frames}, par AS (SELECT w, greatest(1, CAST(floor(w * 0.25) AS BIGINT)) AS s FROM (SELECT ({width}) AS w)),
st AS (SELECT recording_id, label, n, w, unnest(CASE WHEN n > w THEN list_distinct(list_append(range(0, n - w + 1, s), n - w)) ELSE list_distinct([0, (w - n) // 2, w - n]) END) AS start FROM n, par),
wf AS (SELECT st.recording_id, st.label, CAST(st.start AS INTEGER) AS start, g.t, coalesce(fr.x, 0) AS x, fr.pad, fr.z, fr.r
  FROM st JOIN LATERAL (SELECT unnest(range(0, st.w)) AS t) g ON true
  LEFT JOIN fr ON fr.recording_id = st.recording_id AND fr.t = CASE WHEN st.n > st.w THEN st.start + g.t ELSE g.t - st.start END),
wd AS (SELECT *, x - lag(x) OVER (PARTITION BY recording_id, start ORDER BY t) AS d FROM wf)"""


QUANTILE = "SELECT CAST(floor(quantile_cont(n, 0.9)) AS BIGINT) FROM n"
KEYS = "recording_id, label, start"
STRONGEST = ", ".join(f"max({z(p)}) AS z{i}, arg_max({r(p)}, ({z(p)}) * 100000 - t) AS r{i}" for i, p in enumerate(PADS))
TIMES = [(i, level, p) for i, p in enumerate(PADS) for level in LEVELS]
FIRST = ", ".join(f"min(t) FILTER (WHERE ({z(p)}) + 1 = {level}) AS f{i}_{level}" for i, level, p in TIMES)


def rank(k: int) -> str:
    own = "f{}_{}".format(*TIMES[k][:2])
    before = " + ".join(f"coalesce(CAST(f{i}_{level} {'<=' if j < k else '<'} {own} AS INTEGER), 0)" for j, (i, level, _) in enumerate(TIMES) if j != k)
    return f"CASE WHEN {own} IS NULL THEN 0 ELSE 1 + {before} END AS pad{TIMES[k][0]}_{TIMES[k][1]}"


STATS = f"{r6('avg(x)')} AS flex0_mean, {r6('var_pop(x)')} AS flex0_var, {r6('sum(abs(d))')} AS flex0_energy"
VECTORS = """v AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS class_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) = 64), test AS (SELECT * FROM v WHERE id % 5 = 0), train AS (SELECT * FROM v WHERE id % 5 <> 0)"""
NEAREST = f"""{VECTORS}, d AS (SELECT a.id, b.id AS neighbour, b.class_id, round(list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))), 9) AS d2 FROM test a, train b),
near AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY d2, neighbour) AS rank, neighbour, class_id, sqrt(d2) AS distance FROM d QUALIFY rank <= 5)"""
DECIDE = f"SELECT id, arg_max(class_id, {{'p': prob, 'low': -class_id}}) AS predicted, {r6('max(prob)')} AS confidence FROM shares GROUP BY id"
REPORT = """c AS (SELECT quality AS y, toxic AS predicted, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2),
k AS (SELECT y AS class_id FROM c UNION SELECT predicted FROM c),
s AS (SELECT class_id, (SELECT coalesce(sum(n), 0) FROM c WHERE y = class_id AND predicted = class_id) AS tp, (SELECT coalesce(sum(n), 0) FROM c WHERE y = class_id) AS support,
  (SELECT coalesce(sum(n), 0) FROM c WHERE predicted = class_id) AS said FROM k),
rep AS (SELECT class_id, coalesce(tp / nullif(said, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(said + support, 0), 0) AS f1, CAST(support AS BIGINT) AS support FROM s)"""
SEQUENCES = f"WITH {FRAMES}, sq AS (SELECT recording_id, t, x, least(n, 78) AS n FROM fr JOIN n USING (recording_id) WHERE t < 78)"


def debounce(size: int, strict: bool) -> str:
    gate = "false" if strict else "gated"
    passes = "top > 0.5" if strict else "top >= 0.5"
    fails = f"(NOT ({passes}) OR (f.wait > 0 AND q.best = f.last))"
    return f"""WITH RECURSIVE {FRAMES}, a AS (SELECT recording_id AS session, t, round_even(x * 16, 0) / 16 AS a FROM fr),
p AS (SELECT session, t, CASE WHEN t % 12 < 8 THEN a ELSE (1 - a) / 2 END AS p0, CASE WHEN t % 12 < 8 THEN (1 - a) / 2 ELSE a END AS p1, (1 - a) / 2 AS p2 FROM a),
g AS (SELECT *, greatest(p0, p1, p2) < 0.5 AS gated FROM p),
m AS (SELECT session, t, gated, {", ".join(f"sum(CASE WHEN gated THEN CAST(0 AS DOUBLE) ELSE p{i} END) OVER w / {size} AS m{i}" for i in range(3))}
  FROM g WINDOW w AS (PARTITION BY session ORDER BY t ROWS {size - 1} PRECEDING)),
q AS (SELECT session, t, gated, greatest(m0, m1, m2) AS top, CASE WHEN m0 >= m1 AND m0 >= m2 THEN 0 WHEN m1 >= m2 THEN 1 ELSE 2 END AS best FROM m),
f AS (SELECT session, CAST(-1 AS BIGINT) AS t, 0 AS wait, -1 AS last, false AS emitted, CAST(0 AS DOUBLE) AS confidence FROM (SELECT DISTINCT session FROM q)
  UNION ALL SELECT f.session, q.t,
    CASE WHEN {gate} THEN greatest(0, f.wait - 1) WHEN q.t < {size - 1} THEN f.wait WHEN {fails} THEN greatest(0, f.wait - 1) ELSE 4 END,
    CASE WHEN {gate} OR q.t < {size - 1} OR {fails} THEN f.last ELSE q.best END,
    NOT ({gate} OR q.t < {size - 1} OR {fails}), q.top
  FROM f JOIN q ON q.session = f.session AND q.t = f.t + 1)
SELECT session, CAST(t AS INTEGER) AS window_id, CAST(last AS INTEGER) AS class_id, {r6("confidence")} AS confidence FROM f WHERE emitted"""


RECOGNISED = 7
STATS6 = ("mean", "var", "energy", "hi", "lo", "slope")


def emitted(k: int, size: int, threshold: str, cooldown: int, strict: bool = True) -> str:
    """f: the fold of class probabilities p (session, t, p0 ..), gated windows counting as zeros in the mean; not strict: as in debounce()."""
    top, gate = f"greatest({', '.join(f'm{i}' for i in range(k))})", "false" if strict else "q.gated"
    fails = f"(NOT (q.top {'>' if strict else '>='} {threshold}) OR (f.wait > 0 AND q.best = f.last))"
    best = "CASE " + " ".join(f"WHEN m{i} = {top} THEN {i}" for i in range(k)) + " END"
    return f"""g AS (SELECT *, greatest({', '.join(f'p{i}' for i in range(k))}) < {threshold} AS gated FROM p),
m AS (SELECT session, t, gated, {", ".join(f"sum(CASE WHEN gated THEN CAST(0 AS DOUBLE) ELSE p{i} END) OVER w / {size} AS m{i}" for i in range(k))}
  FROM g WINDOW w AS (PARTITION BY session ORDER BY t ROWS {size - 1} PRECEDING)),
q AS (SELECT session, t, gated, {top} AS top, {best} AS best FROM m),
f AS (SELECT session, CAST(-1 AS BIGINT) AS t, 0 AS wait, -1 AS last, false AS emitted, CAST(0 AS DOUBLE) AS confidence FROM (SELECT DISTINCT session FROM q)
  UNION ALL SELECT f.session, q.t, CASE WHEN {gate} THEN greatest(0, f.wait - 1) WHEN q.t < {size - 1} THEN f.wait WHEN {fails} THEN greatest(0, f.wait - 1) ELSE {cooldown} END,
    CASE WHEN {gate} OR q.t < {size - 1} OR {fails} THEN f.last ELSE q.best END, NOT ({gate} OR q.t < {size - 1} OR {fails}), q.top
  FROM f JOIN q ON q.session = f.session AND q.t = f.t + 1)"""


PROBABILITIES = """, l AS (SELECT id, class_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM train),
fl AS (SELECT 1e-9 * max(s) AS e FROM (SELECT var_pop(x) AS s FROM l GROUP BY pos)),
mv AS (SELECT class_id, pos, avg(x) AS m, var_pop(x) + (SELECT e FROM fl) AS s FROM l GROUP BY 1, 2),
pr AS (SELECT class_id, count(*) / (SELECT count(*) FROM train) AS prior FROM train GROUP BY 1),
tt AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM test),
sc AS (SELECT tt.id, mv.class_id, any_value(ln(prior)) + sum(-0.5 * ln(2 * pi() * s) - (x - m) * (x - m) / (2 * s)) AS score FROM tt JOIN mv USING (pos) JOIN pr USING (class_id) GROUP BY 1, 2),
ex AS (SELECT id, class_id, exp(score - max(score) OVER (PARTITION BY id)) AS e FROM sc), shares AS (SELECT id, class_id, e / sum(e) OVER (PARTITION BY id) AS prob FROM ex)"""


FEATURES = f""", a AS (SELECT {KEYS}, avg(x) AS mean, var_pop(x) AS var, sum(abs(d)) AS energy, max(x) AS hi, min(x) AS lo, coalesce(regr_slope(x, t), 0) AS slope, {STRONGEST} FROM wd GROUP BY ALL),
raw AS (SELECT recording_id, label AS class_id, start, [{", ".join(STATS6)}, {", ".join(f"z{i} + 1, {bin_of(f'r{i}')}" for i in range(5))}]::DOUBLE[] AS v FROM a WHERE chosen)"""
ALIGNED = f"""WITH {SMOOTHED}, st AS (SELECT recording_id, label, n, unnest(range(0, n, 10)) AS start FROM n),
wf AS (SELECT st.recording_id, st.label, CAST(start AS INTEGER) AS start, t - start + 40 - least(40, n - start) AS t, x, pad, z, r
  FROM st JOIN fr ON fr.recording_id = st.recording_id AND t >= start AND t < start + 40)"""
CHANNELS = ["x", *(f"(({z(p)}) + 1) / CAST(5 AS DOUBLE)" for p in PADS), *(f"CASE WHEN ({r(p)}) >= 900 THEN 1 WHEN ({r(p)}) > 0 THEN 0.5 ELSE 0 END" for p in PADS)]
ALIGNED_RAW = f""", lw AS (SELECT {KEYS}, unnest([{", ".join(f"{{'pos': t * 11 + {i}, 'x': greatest(0, least(1, CAST({c} AS DOUBLE)))}}" for i, c in enumerate(CHANNELS))}]) AS e FROM wf),
own AS (SELECT {KEYS}, map_from_entries(list({{'k': e.pos, 'v': e.x}})) AS m FROM lw GROUP BY ALL),
raw AS (SELECT recording_id, label AS class_id, start, list_transform(range(0, 440), lambda i: coalesce(m[i], CAST(0 AS DOUBLE))) AS v FROM own)"""


def recognised(cut: str, chosen: str = "true", settings: tuple = (2, "0.16", 2, True), raw: str = FEATURES) -> str:
    """Scaler and naive Bayes of the windows of four recordings in five, emissions of the others."""
    size, threshold, cooldown, strict = settings
    return f"""{cut.replace("WITH ", "WITH RECURSIVE ", 1)}{raw.replace("chosen", chosen)},
rl AS (SELECT recording_id, class_id, start, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM raw),
scl AS (SELECT pos, avg(x) AS mu, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS sd FROM rl WHERE recording_id % 5 <> 0 GROUP BY 1),
v AS (SELECT recording_id * 1048576 + start AS id, recording_id, class_id, start, list((x - mu) / sd ORDER BY pos) AS v FROM rl JOIN scl USING (pos) GROUP BY ALL),
test AS (SELECT * FROM v WHERE recording_id % 5 = 0), train AS (SELECT * FROM v WHERE recording_id % 5 <> 0){PROBABILITIES},
num AS (SELECT id, recording_id AS session, row_number() OVER (PARTITION BY recording_id ORDER BY start) - 1 AS t FROM test),
p AS (SELECT session, t, {", ".join(f"max(CASE WHEN class_id = {i} THEN prob END) AS p{i}" for i in range(RECOGNISED))} FROM num JOIN shares USING (id) GROUP BY 1, 2),
{emitted(RECOGNISED, size, threshold, cooldown, strict)}
SELECT session, CAST(t AS INTEGER) AS window_id, last AS label, {r6("confidence")} AS confidence FROM f WHERE emitted"""



def dtw(a: str, b: str, cost: str) -> str:
    """Warping distance of lists a (elements are lists) and b, as a fold whose state is the last row of the table; cost is of v and b[j]."""
    row = f"list_transform(range(1, len({b}) + 1), lambda j: [{cost}, prev[j], prev[j + 1]])"
    step = "list_append(cur, e[1] + least(e[2], e[3], cur[len(cur)]))"
    first = f"list_prepend(CAST(0 AS DOUBLE), list_transform({b}, lambda q: CAST('inf' AS DOUBLE)))"
    fold = f"list_reduce(list_prepend({first}, {a}), lambda prev, v: list_reduce(list_prepend([CAST('inf' AS DOUBLE)], {row}), lambda cur, e: {step}))"
    return f"{fold}[len({b}) + 1] / (len({a}) + len({b}))"


FRAME = f"[x, {', '.join(f'{z(p)}, {r(p)}' for p in PADS)}]::DOUBLE[]"
ANCHORS = f"""{windows("40")}, seqs AS (SELECT {KEYS}, list({FRAME} ORDER BY t) AS a FROM (SELECT {KEYS}, t, x, coalesce(pad, '') AS pad, z, r FROM wf) GROUP BY ALL),
first AS (SELECT label, min(recording_id) AS recording_id FROM n GROUP BY 1),
gf AS (SELECT f.label, g.t, coalesce(fr.x, 0) AS x, coalesce(fr.pad, '') AS pad, fr.z, fr.r FROM first f JOIN n USING (recording_id) JOIN LATERAL (SELECT unnest(range(0, greatest(40, n.n))) AS t) g ON true
  LEFT JOIN fr ON fr.recording_id = f.recording_id AND fr.t = g.t - greatest(0, (40 - n.n) // 2)),
gold AS (SELECT label AS anchor, list({FRAME} ORDER BY t) AS b FROM gf GROUP BY 1),
far AS MATERIALIZED (SELECT {KEYS}, anchor, {dtw("a", "b", "list_distance(v, b[j])")} AS distance FROM seqs, gold)"""
WARPED = f"""WITH {FRAMES}, st AS (SELECT recording_id, label, unnest(range(0, n - 39, 40)) AS start FROM n WHERE n >= 40),
ag AS (SELECT st.recording_id, st.label, start, list(x ORDER BY t) AS xs, {STRONGEST} FROM st JOIN fr ON fr.recording_id = st.recording_id AND t >= start AND t < start + 40 GROUP BY ALL),
own AS (SELECT recording_id, recording_id * 1000 + start AS id, CAST(label AS BIGINT) AS class_id, xs, [{", ".join(f"z{i} + 1, {bin_of(f'r{i}')}" for i in range(5))}]::DOUBLE[] AS ps FROM ag),
ds AS (SELECT q.id, o.id AS neighbour, o.class_id, round({dtw("list_transform(q.xs, lambda x: [x])", "o.xs", "abs(v[1] - o.xs[j])")} + list_distance(q.ps, o.ps), 9) AS d
  FROM own q, own o WHERE q.recording_id % 5 = 0 AND o.recording_id % 5 <> 0),
near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbour) AS rank FROM ds QUALIFY rank <= 5)"""
SCALED_OWN = """plain AS (SELECT recording_id, recording_id * 1000 + start AS id, CAST(label AS BIGINT) AS class_id, list_concat(xs, [""" + ", ".join(f"z{i} + 1, {bin_of(f'r{i}')}" for i in range(5)) + """]::DOUBLE[]) AS v FROM ag),
long AS (SELECT recording_id, id, class_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM plain),
scl AS (SELECT pos, avg(x) AS mu, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS sd FROM long WHERE recording_id % 5 <> 0 GROUP BY 1),
sv AS (SELECT recording_id, id, class_id, list((x - mu) / sd ORDER BY pos) AS v FROM long JOIN scl USING (pos) GROUP BY ALL),
own AS (SELECT recording_id, id, class_id, v[1:40] AS xs, v[41:50] AS ps FROM sv),
unscaled AS"""


def draw(key: str, seed: str, *place: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join((seed, key, *place))})), 1, 8) AS BIGINT)"


def augmented_steps(width: int, repeats: int) -> str:
    """s4: recording_id, repeat, path, n, seq after four steps, each by the transform that its row's order names."""
    names = ("time_warp", "flex_noise", "temporal_shift", "frame_dropout")
    order = ", ".join(f"{{'h': {draw('path', '42', repr(k))}, 'name': '{k}'}}" for k in names)
    pad = f"list_resize(%s, {width}, CAST(0 AS DOUBLE))"
    unit = lambda k: f"(({draw('path', str(42 + k), 'i - 1', '0')} + CAST(0.5 AS DOUBLE)) / 4294967296)"
    noise = f"CASE WHEN i - 1 < n THEN greatest(0, least(1, x + CAST(0.01 AS DOUBLE) * sqrt(-2 * ln({unit(0)})) * cos(CAST(6.283185307179586 AS DOUBLE) * {unit(1)}))) ELSE x END"
    at = "seq[q + 1] + (seq[least(q + 1, n - 1) + 1] - seq[q + 1]) * (p - q)"
    at = at.replace("p - q", "i * (n - 1) / CAST(m - 1 AS DOUBLE) - i * (n - 1) // (m - 1)").replace("q + 1", "i * (n - 1) // (m - 1) + 1")
    warped = pad % f"list_transform(range(0, m), lambda i: {at})"
    moved = f"CASE WHEN delta >= 0 THEN list_concat(list_transform(range(0, delta), lambda i: CAST(0 AS DOUBLE)), seq[1:n]) ELSE seq[1 - delta:n] END"
    size, first = f"(1 + {draw('path', '44')} % 3)", f"({draw('path', '45')} % greatest(n - size, 1))"

    def step(k: int) -> str:
        own = f"FROM s{k} WHERE ord[{k + 1}] = "
        rest = "recording_id, repeat, ord"
        return f"""s{k + 1} AS MATERIALIZED (
  SELECT {rest}, path || '|w' || f AS path, CASE WHEN n >= 2 THEN m ELSE n END AS n, CASE WHEN n >= 2 THEN {warped} ELSE seq END AS seq
    FROM (SELECT *, greatest(2, least({width}, CAST(round_even(n * [0.7::DOUBLE, 0.85, 1.15, 1.3][f + 1], 0) AS BIGINT))) AS m FROM (SELECT *, unnest([0, 1, 2, 3]) AS f {own}'time_warp'))
  UNION ALL SELECT {rest}, path || '|s' || f, greatest(0, CASE WHEN delta >= 0 THEN least(n, {width} - delta) ELSE n + delta END), {pad % moved}
    FROM (SELECT *, CAST(trunc([0.5::DOUBLE, 1, -0.5, -1][f + 1] * greatest(10, {width} - n)) AS BIGINT) AS delta FROM (SELECT *, unnest([0, 1, 2, 3]) AS f {own}'temporal_shift'))
  UNION ALL SELECT {rest}, path || '|n', n, list_transform(seq, lambda x, i: {noise}) {own}'flex_noise'
  UNION ALL SELECT {rest}, path || '|d', n, CASE WHEN n >= 4 AND n - size >= 1 THEN list_transform(seq, lambda x, i: CASE WHEN i - 1 >= first AND i - 1 < first + size THEN CAST(0 AS DOUBLE) ELSE x END) ELSE seq END
    FROM (SELECT *, {first} AS first FROM (SELECT *, {size} AS size {own}'frame_dropout')))"""

    return f"""{SEQUENCES}, whole AS (SELECT recording_id, any_value(n) AS n, list(x ORDER BY t) AS seq FROM sq GROUP BY 1),
rp AS (SELECT recording_id, n, {pad % "seq"} AS seq, unnest(range(0, {repeats})) AS repeat FROM whole), pt AS (SELECT *, recording_id || ':' || repeat AS path FROM rp),
s0 AS MATERIALIZED (SELECT recording_id, repeat, list_transform(list_sort([{order}]), lambda o: o.name) AS ord, path, n, seq FROM pt),
{", ".join(step(k) for k in range(4))}"""


SQL = {
    "window_features": f"""{windows("40")}, a AS (SELECT {KEYS}, {STATS}, max(x) AS hi, min(x) AS lo, regr_slope(x, t) AS slope, {STRONGEST}, {FIRST} FROM wd GROUP BY ALL)
SELECT {KEYS}, flex0_mean, flex0_var, flex0_energy, {r6("hi")} AS flex0_max, {r6("lo")} AS flex0_min, {r6("coalesce(slope, 0)")} AS flex0_slope,
  {", ".join(f"z{i} + 1 AS pad{i}_max_z, {bin_of(f'r{i}')} AS pad{i}_corr_r" for i in range(5))}, {", ".join(rank(k) for k in range(len(TIMES)))} FROM a""",
    "quantile_window_features": f"""{windows(QUANTILE)}, a AS (SELECT {KEYS}, {STATS}, {STRONGEST} FROM wd GROUP BY ALL)
SELECT {KEYS}, flex0_mean, flex0_var, flex0_energy, {", ".join(f"z{i} AS pad{i}_max_z, r{i} AS pad{i}_corr_r" for i in range(5))} FROM a""",
    "trend_changes": f"""{windows("40").replace("WITH ", "WITH RECURSIVE ", 1)},
f AS (SELECT {KEYS}, t, x AS ref, 0 AS way, 0 AS changes FROM wf WHERE t = 0
  UNION ALL SELECT f.recording_id, f.label, f.start, w.t,
    CASE WHEN (f.way <= 0 AND w.x - f.ref >= CAST(0.4 AS DOUBLE)) OR (f.way >= 0 AND f.ref - w.x >= CAST(0.4 AS DOUBLE)) OR (f.way = 1 AND w.x > f.ref) OR (f.way = -1 AND w.x < f.ref) THEN w.x ELSE f.ref END,
    CASE WHEN f.way <= 0 AND w.x - f.ref >= CAST(0.4 AS DOUBLE) THEN 1 WHEN f.way >= 0 AND f.ref - w.x >= CAST(0.4 AS DOUBLE) THEN -1 ELSE f.way END,
    f.changes + CASE WHEN (f.way <= 0 AND w.x - f.ref >= CAST(0.4 AS DOUBLE)) OR (f.way >= 0 AND f.ref - w.x >= CAST(0.4 AS DOUBLE)) THEN 1 ELSE 0 END
  FROM f JOIN wf w ON w.recording_id = f.recording_id AND w.start = f.start AND w.t = f.t + 1)
SELECT {KEYS}, CAST(changes AS BIGINT) AS changes FROM f WHERE t = 39""",
    "raw_vectors": f"""{windows("40")}, a AS (SELECT {KEYS}, sum(x * (t + 1)) AS x, {STRONGEST} FROM wf GROUP BY ALL)
SELECT {KEYS}, CAST(50 AS BIGINT) AS size, {r6("x + " + " + ".join(f"(z{i} + 1) * {41 + 2 * i} + ({bin_of(f'r{i}')}) * {42 + 2 * i}" for i in range(5)))} AS weighted FROM a""",
    "stream_windows": f"""WITH {FRAMES}, st AS (SELECT recording_id, label, unnest(range(0, n - 39, 10)) AS start FROM n WHERE n >= 40)
SELECT st.recording_id, st.label, CAST(start AS INTEGER) AS start, count(*) AS n, {r6("sum(x * (t - start + 1))")} AS weighted FROM st JOIN fr ON fr.recording_id = st.recording_id AND t >= start AND t < start + 40 GROUP BY ALL""",
    "aligned_windows": f"""WITH {FRAMES}, st AS (SELECT recording_id, label, n, unnest(range(0, n, 10)) AS start FROM n)
SELECT st.recording_id, st.label, CAST(start AS INTEGER) AS start, CAST(40 AS BIGINT) AS n, count(*) AS real, {r6("sum(x * (t - start + 40 - least(40, n - start)))")} AS weighted
FROM st JOIN fr ON fr.recording_id = st.recording_id AND t >= start AND t < start + 40 GROUP BY ALL""",
    "padded": f"""WITH {FRAMES} SELECT recording_id, fr.label, CAST(78 AS BIGINT) AS n, greatest(0, 78 - any_value(n.n)) AS padding, {r6("coalesce(sum(x * (t + 1)) FILTER (WHERE t < 78), 0)")} AS weighted
FROM fr JOIN n USING (recording_id) GROUP BY ALL""",
    "smoothed_flex": f"WITH {FRAMES} SELECT recording_id, CAST(t AS INTEGER) AS t, {r6('avg(x) OVER (PARTITION BY recording_id ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)')} AS x FROM fr",
    "normalised_pads": f"""WITH {FRAMES}, p AS (SELECT recording_id, t, i AS no, CASE WHEN pad = ['click','error','purchase','signup','view'][i + 1] THEN z ELSE -1 END AS z,
  CASE WHEN pad = ['click','error','purchase','signup','view'][i + 1] THEN r ELSE 0 END AS r FROM fr, range(0, 5) g(i))
SELECT recording_id, CAST(t AS INTEGER) AS t, CAST(no AS INTEGER) AS pad, {r6("greatest(0, least(1, (z + 1) / CAST(5 AS DOUBLE)))")} AS z, CAST(CASE WHEN r > 0 AND r < 900 THEN 0.5 WHEN r >= 900 THEN 1 ELSE 0 END AS DOUBLE) AS r, {bin_of("r")} AS bin FROM p""",
    "channel_ranges": f"""WITH {FRAMES} SELECT 0 AS channel, count(*) AS n, {r6("min(x)")} AS min, {r6("max(x)")} AS max, {r6("avg(x)")} AS mean, {r6("stddev_pop(x)")} AS std, min(x) >= -1e-5 AND max(x) <= 1 + 1e-5 AS in_range FROM fr""",
    "top_labels": "SELECT source AS label, count(*) AS n, min(doc_id) AS first_seen FROM documents GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 20",
    "exemplar_sizes": f"""WITH {FRAMES}, first AS (SELECT label, min(recording_id) AS recording_id FROM n GROUP BY 1)
SELECT f.label, greatest(78, any_value(n.n)) AS n, {r6("sum(x * (t + greatest(0, (78 - n.n) // 2) + 1))")} AS weighted FROM first f JOIN fr USING (recording_id) JOIN n USING (recording_id) GROUP BY 1""",
    "label_codes": "SELECT doc_id, source AS label, CASE WHEN source IS NOT NULL THEN dense_rank() OVER (ORDER BY source NULLS LAST) - 1 END AS class_id FROM documents",
    "one_hot": "SELECT vec_id, CAST(i AS INTEGER) AS pos, CAST(i = label AS INTEGER) AS hot FROM embeddings, range(0, 10) g(i)",
    "scaled_vectors": f"""WITH {VECTORS}, l AS (SELECT id, id % 5 = 0 AS is_test, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM v),
s AS (SELECT pos, avg(x) AS m, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS s FROM l WHERE NOT is_test GROUP BY 1)
SELECT id, is_test, CAST(pos AS INTEGER) AS pos, {r6("(x - m) / s")} AS x FROM l JOIN s USING (pos)""",
    "knn_neighbours": f"WITH {NEAREST} SELECT id, CAST(rank AS INTEGER) AS rank, neighbour, class_id, {r6('distance')} AS distance FROM near",
    "knn_predictions": f"WITH {NEAREST}, shares AS (SELECT id, class_id, count(*) / sum(count(*)) OVER (PARTITION BY id) AS prob FROM near GROUP BY 1, 2) {DECIDE}",
    "knn_weighted": f"""WITH {NEAREST}, o AS (SELECT *, min(distance) OVER (PARTITION BY id) = 0 AS zero FROM near),
w AS (SELECT id, class_id, sum(CASE WHEN zero THEN CAST(distance = 0 AS INTEGER) ELSE 1 / distance END) AS s FROM o GROUP BY 1, 2),
shares AS (SELECT id, class_id, s / sum(s) OVER (PARTITION BY id) AS prob FROM w) {DECIDE}""",
    "bayes_predictions": f"""WITH {VECTORS}, l AS (SELECT id, class_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM train),
fl AS (SELECT 1e-9 * max(s) AS e FROM (SELECT var_pop(x) AS s FROM l GROUP BY pos)),
st AS (SELECT class_id, pos, avg(x) AS m, var_pop(x) + (SELECT e FROM fl) AS s FROM l GROUP BY 1, 2),
pr AS (SELECT class_id, count(*) / (SELECT count(*) FROM train) AS prior FROM train GROUP BY 1),
t AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM test),
sc AS (SELECT t.id, st.class_id, any_value(ln(prior)) + sum(-0.5 * ln(2 * pi() * s) - (x - m) * (x - m) / (2 * s)) AS score FROM t JOIN st USING (pos) JOIN pr USING (class_id) GROUP BY 1, 2),
ex AS (SELECT id, class_id, exp(score - max(score) OVER (PARTITION BY id)) AS e FROM sc), shares AS (SELECT id, class_id, e / sum(e) OVER (PARTITION BY id) AS prob FROM ex) {DECIDE}""",
    "class_report": f"WITH {REPORT} SELECT class_id, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1, support FROM rep",
    "confusion": "SELECT quality AS y, toxic AS predicted, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2",
    "metric_summary": f"""WITH {REPORT} SELECT {r6("avg(precision)")} AS precision, {r6("avg(recall)")} AS recall, {r6("avg(f1)")} AS f1,
  (SELECT {r6("sum(CASE WHEN y = predicted THEN n ELSE 0 END) / sum(n)")} FROM c) AS accuracy FROM rep""",
    "debounced_mean": debounce(4, True),
    "debounced_gate": debounce(3, False),
    "time_warp": f"""{SEQUENCES}, m AS (SELECT DISTINCT recording_id, n, factor, greatest(2, least(78, CAST(round_even(n * factor, 0) AS BIGINT))) AS m FROM sq, (SELECT unnest([0.7::DOUBLE, 0.85, 1.15, 1.3]) AS factor)),
i AS (SELECT *, unnest(range(0, m)) AS i FROM m), p AS (SELECT *, i * (n - 1) / CAST(m - 1 AS DOUBLE) AS p FROM i)
SELECT p.recording_id, p.factor, p.m AS n, {r6("sum((a.x + (b.x - a.x) * (p.p - floor(p.p))) * p.i)")} AS weighted FROM p
JOIN sq a ON a.recording_id = p.recording_id AND a.t = CAST(floor(p.p) AS BIGINT) JOIN sq b ON b.recording_id = p.recording_id AND b.t = least(CAST(floor(p.p) AS BIGINT) + 1, p.n - 1) GROUP BY 1, 2, 3""",
    "temporal_shift": f"""{SEQUENCES}, s AS (SELECT *, CAST(trunc(share * greatest(10, 78 - n)) AS BIGINT) AS shift FROM sq, (SELECT unnest([0.5::DOUBLE, 1, -0.5, -1]) AS share))
SELECT recording_id, shift, greatest(0, CASE WHEN shift >= 0 THEN least(n, 78 - shift) ELSE n + shift END) AS n,
  {r6("coalesce(sum(x * (t + shift)) FILTER (WHERE t + shift BETWEEN 0 AND 77), 0)")} AS weighted FROM s GROUP BY recording_id, share, shift, n""",
    "augmented": f"""{augmented_steps(78, 8)}
SELECT recording_id, CAST(repeat AS INTEGER) AS repeat, count(*) AS copies, CAST(sum(n) AS BIGINT) AS real, {r6("sum(list_sum(list_transform(seq, lambda x, i: x * i)))")} AS weighted, min(path) AS first_path FROM s4 GROUP BY 1, 2""",
    "anchor_distances": f"{ANCHORS} SELECT {KEYS}, anchor, {r6('distance')} AS distance FROM far",
    "wide_anchor_distances": f"{ANCHORS} SELECT {KEYS}, {', '.join(f'max(CASE WHEN anchor = {i} THEN ' + r6('distance') + f' END) AS dtw_{i}' for i in range(7))} FROM far GROUP BY ALL",
    "warped_neighbours": f"{WARPED} SELECT id, CAST(rank AS INTEGER) AS rank, neighbour, class_id, {r6('d')} AS distance FROM near",
    "knn_recognised": f"""{WARPED.replace("WITH ", "WITH RECURSIVE ", 1).replace("own AS", SCALED_OWN)},
o AS (SELECT *, min(d) OVER (PARTITION BY id) = 0 AS zero FROM near), w AS (SELECT id, class_id, sum(CASE WHEN zero THEN CAST(d = 0 AS INTEGER) ELSE 1 / d END) AS s FROM o GROUP BY 1, 2),
shares AS (SELECT id, class_id, s / sum(s) OVER (PARTITION BY id) AS prob FROM w),
p AS (SELECT id // 1000 AS session, (id % 1000) // 40 AS t, {", ".join(f"coalesce(max(CASE WHEN class_id = {i} THEN prob END), 0) AS p{i}" for i in range(7))} FROM shares GROUP BY id),
{emitted(7, 1, "0.2", 1)}
SELECT session, CAST(t AS INTEGER) AS window_id, last AS label, {r6("confidence")} AS confidence FROM f WHERE emitted""",
    "ranked_probabilities": f"""WITH {VECTORS}{PROBABILITIES}, o AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY prob DESC, class_id) AS rank, class_id, prob FROM shares)
SELECT id, CAST(rank AS INTEGER) AS rank, class_id, {r6("prob")} AS prob FROM o WHERE rank <= 3""",
    "decoded_labels": "SELECT doc_id, source AS label, CASE WHEN source IS NOT NULL THEN dense_rank() OVER (ORDER BY source NULLS LAST) - 1 END AS class_id FROM documents",
    "emission_summary": f"""WITH e AS ({debounce(4, True).replace(r6("confidence") + " AS confidence", "confidence")})
SELECT class_id, count(*) AS n, count(DISTINCT session) AS sessions, {r6("avg(confidence)")} AS confidence, min(window_id) AS first_window FROM e GROUP BY 1""",
    "split_parts": """WITH d AS (SELECT doc_id AS recording_id, source AS label, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE source IS NOT NULL),
k AS (SELECT *, CASE WHEN (SELECT min(n) FROM d) >= 3 THEN label ELSE '' END AS part_of FROM d),
o AS (SELECT recording_id, label, row_number() OVER (PARTITION BY part_of ORDER BY md5('42:' || CAST(recording_id AS VARCHAR)), recording_id) AS place, floor(count(*) OVER (PARTITION BY part_of) * 0.3::DOUBLE + 0.5) AS gone FROM k)
SELECT recording_id, label, CASE WHEN place > gone THEN 'train' WHEN place <= ceil(gone * 0.5) THEN 'validation' ELSE 'test' END AS part FROM o""",
    "learning_rates": f"""WITH RECURSIVE {FRAMES},
f AS (SELECT recording_id AS run, CAST(-1 AS BIGINT) AS epoch, CAST(0 AS DOUBLE) AS used, false AS trained, CAST(0.001 AS DOUBLE) AS rate, CAST('inf' AS DOUBLE) AS best, CAST('inf' AS DOUBLE) AS low, 0 AS wait, 0 AS idle FROM n
  UNION ALL SELECT f.run, r.t, f.rate, f.idle < 10,
    CASE WHEN f.idle < 10 AND NOT (r.x < f.best - 1e-4) AND f.wait = 4 THEN greatest(f.rate * CAST(0.5 AS DOUBLE), CAST(1e-6 AS DOUBLE)) ELSE f.rate END,
    CASE WHEN f.idle < 10 AND r.x < f.best - 1e-4 THEN r.x ELSE f.best END, CASE WHEN f.idle < 10 AND r.x < f.low THEN r.x ELSE f.low END,
    CASE WHEN r.x < f.best - 1e-4 OR f.wait = 4 THEN 0 ELSE f.wait + 1 END, CASE WHEN f.idle >= 10 THEN f.idle WHEN r.x < f.low THEN 0 ELSE f.idle + 1 END
  FROM f JOIN fr r ON r.recording_id = f.run AND r.t = f.epoch + 1)
SELECT run, CAST(epoch AS INTEGER) AS epoch, used AS learning_rate, trained FROM f WHERE epoch >= 0""",
    "recognised": recognised(windows("40")),
    "recognised_smooth": recognised(windows("40", SMOOTHED), "start % 10 = 0 AND (SELECT n FROM n WHERE n.recording_id = a.recording_id) >= 40", (2, "0.2", 2, True)),
    "recognised_aligned": recognised(ALIGNED, settings=(3, "0.9", 2, False), raw=ALIGNED_RAW),
}
