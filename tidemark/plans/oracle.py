"""SQL for the registered queries: the same rows from the same tables, written for a SQL engine on its own terms."""

from __future__ import annotations

GRID = """
hours AS (SELECT event_type AS channel, date_trunc('hour', ts) AS ts, avg(value) AS x FROM events GROUP BY 1, 2),
span AS (SELECT min(ts) AS t0, max(ts) AS t1 FROM hours),
calendar AS (SELECT unnest(generate_series(t0, t1, INTERVAL 1 HOUR)) AS ts, t0 FROM span),
grid AS (
  SELECT n.channel, CAST(date_diff('hour', c.t0, c.ts) AS BIGINT) AS idx, c.ts, round(h.x, 8) AS x
  FROM calendar c CROSS JOIN (SELECT DISTINCT channel FROM hours) n LEFT JOIN hours h ON h.channel = n.channel AND h.ts = c.ts)
"""
SIGNAL = (
    GRID
    + """,
smooth AS (SELECT *, round(avg(x) OVER (PARTITION BY channel ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 10) AS s FROM grid),
first_d AS (SELECT *, round(s - lag(s) OVER (PARTITION BY channel ORDER BY idx), 10) AS d1 FROM smooth),
sig AS (SELECT *, round(d1 - lag(d1) OVER (PARTITION BY channel ORDER BY idx), 10) AS d2 FROM first_d)
"""
)
EXTREMA = (
    SIGNAL
    + """,
near_d AS (SELECT *, lag(d1) OVER w AS p, lead(d1) OVER w AS n FROM sig WINDOW w AS (PARTITION BY channel ORDER BY idx)),
extrema AS (
  SELECT channel, idx, CASE WHEN p < d1 THEN 'max' ELSE 'min' END AS sign, abs(d1 - (p + n) / 2) AS amplitude, s AS value, d1 AS first_diff, d2 AS second_diff
  FROM near_d WHERE (p < d1 AND d1 >= n) OR (p > d1 AND d1 <= n))
"""
)
# a peak's feet: the last place before it and the first after it where a walk stops
PEAKS = (
    SIGNAL
    + """,
near_s AS (SELECT *, lag(s) OVER w AS p, lead(s) OVER w AS n FROM sig WINDOW w AS (PARTITION BY channel ORDER BY idx)),
walks AS (
  SELECT channel, idx, s, CASE WHEN p < s AND s >= n THEN 'max' WHEN p > s AND s <= n THEN 'min' END AS sign,
    max(CASE WHEN coalesce(p <= s, FALSE) THEN NULL ELSE idx END) OVER back AS up_l, max(CASE WHEN coalesce(p >= s, FALSE) THEN NULL ELSE idx END) OVER back AS dn_l,
    min(CASE WHEN coalesce(n <= s, FALSE) THEN NULL ELSE idx END) OVER ahead AS up_r, min(CASE WHEN coalesce(n >= s, FALSE) THEN NULL ELSE idx END) OVER ahead AS dn_r
  FROM near_s
  WINDOW back AS (PARTITION BY channel ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ahead AS (PARTITION BY channel ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
feet AS (SELECT channel, idx, s, sign, CASE sign WHEN 'max' THEN up_l ELSE dn_l END AS left_idx, CASE sign WHEN 'max' THEN up_r ELSE dn_r END AS right_idx FROM walks WHERE sign IS NOT NULL),
peaks AS (
  SELECT f.channel, f.idx, f.sign, f.s AS value,
    greatest(CASE f.sign WHEN 'max' THEN f.s - greatest(l.s, r.s) ELSE least(l.s, r.s) - f.s END, 0.0) AS prominence, CAST(greatest(right_idx - left_idx, 1) AS DOUBLE) AS width,
    abs((f.s - l.s) / greatest(f.idx - left_idx, 1)) AS rise_slope, abs((f.s - r.s) / greatest(right_idx - f.idx, 1)) AS fall_slope,
    greatest(f.idx - left_idx, 1) / greatest(right_idx - f.idx, 1) AS asymmetry, l.s AS left_base, r.s AS right_base, left_idx, right_idx
  FROM feet f JOIN sig l ON l.channel = f.channel AND l.idx = f.left_idx JOIN sig r ON r.channel = f.channel AND r.idx = f.right_idx)
"""
)
WINDOWS = """,
size AS (SELECT max(idx) + 1 AS n FROM grid),
win AS (SELECT unnest(generate_series(0, n - 24)) AS window_id FROM size)
"""
ONE = """,
one AS (SELECT window_id, window_id AS start_idx, window_id + 23 AS end_idx, CAST(floor(window_id / 120) AS BIGINT) AS block_id FROM win)
"""
BACKTEST = (
    GRID
    + """,
th AS (SELECT channel, coalesce(quantile_cont(x, 0.9), 0) AS upper, coalesce(quantile_cont(x, 0.1), 0) AS lower FROM grid GROUP BY 1),
known AS (SELECT channel, idx, x FROM grid WHERE x IS NOT NULL),
pairs AS (
  SELECT a.channel, h AS horizon, a.x + (t.upper - a.x) * h / 240 - b.x AS e, a.x - b.x AS be
  FROM known a CROSS JOIN generate_series(1, 24) g(h) JOIN th t ON t.channel = a.channel JOIN known b ON b.channel = a.channel AND b.idx = a.idx + h),
stats AS (
  SELECT channel, horizon, count(*) AS n, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, count(*) AS baseline_n, avg(abs(be)) AS baseline_mae, sqrt(avg(be * be)) AS baseline_rmse
  FROM pairs GROUP BY GROUPING SETS ((channel), (channel, horizon)))
"""
)
LINES = (
    GRID
    + """,
lines AS (
  SELECT channel, CAST(floor(idx / 24) AS BIGINT) AS block, count(*) AS n, avg(x) AS mean, CASE WHEN var_pop(idx % 24) > 0 THEN regr_slope(x, CAST(idx % 24 AS DOUBLE)) ELSE 0 END AS slope, avg(CAST(idx % 24 AS DOUBLE)) AS t
  FROM grid WHERE x IS NOT NULL GROUP BY 1, 2),
fits AS (SELECT channel, block, n, mean, mean - slope * t AS intercept, slope FROM lines),
segs AS (
  SELECT channel, block AS segment_id, block * 24 AS start_idx, block * 24 + 23 AS end_idx, 24 AS duration, CASE block % 3 WHEN 0 THEN 'constant' WHEN 1 THEN 'linear' ELSE 'harmonic' END AS eq_type,
    intercept AS L, slope AS c, mean - intercept AS A, slope AS B, abs(slope) AS rms FROM fits)
"""
)
#: Each step's best predictor by regression over frames, then short runs: within a stretch of known labels the first runs take the label of
#: the run at which they reach three steps together, later short ones that of the run before.
REGIMES = (
    SIGNAL
    + """,
lagged AS (
  SELECT channel, idx, s, lag(s, 1) OVER o AS x1, lag(s, 2) OVER o AS x2, lag(s, 3) OVER o AS x3, count(s) OVER (o ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS n FROM sig WINDOW o AS (PARTITION BY channel ORDER BY idx)),
moments AS (
  SELECT *, avg(s) OVER f AS my, avg(x1) OVER f AS ma, avg(x2) OVER f AS mb, covar_pop(s, x1) OVER f AS ya, covar_pop(s, x2) OVER f AS yb, covar_pop(x1, x2) OVER f AS ab, var_pop(x1) OVER f AS va, var_pop(x2) OVER f AS vb
  FROM lagged WINDOW f AS (PARTITION BY channel ORDER BY idx ROWS BETWEEN 22 PRECEDING AND 1 PRECEDING)),
guessed AS (
  SELECT channel, idx, n = 24 AND s IS NOT NULL AS known, abs(s - x1) AS e0, abs(s - (2 * x1 - x2)) AS e1, abs(s - (3 * x1 - 3 * x2 + x3)) AS e2,
    abs(s - (my + (ya * vb - yb * ab) / (va * vb - ab * ab) * (x1 - ma) + (yb * va - ya * ab) / (va * vb - ab * ab) * (x2 - mb))) AS e3 FROM moments),
best AS (
  SELECT channel, idx, CASE WHEN NOT known THEN NULL WHEN e0 <= least(e1, e2, e3) THEN 'level' WHEN e1 <= least(e2, e3) THEN 'velocity' WHEN e2 <= e3 THEN 'acceleration' ELSE 'local_ar2' END AS label FROM guessed),
turns AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY channel ORDER BY idx) THEN 1 ELSE 0 END AS turn FROM best),
numbered AS (SELECT *, sum(turn) OVER (PARTITION BY channel ORDER BY idx) AS run FROM turns),
runs AS (SELECT channel, run, max(label) AS label, count(*) AS n FROM numbered GROUP BY 1, 2),
stretches AS (SELECT *, sum(CASE WHEN label IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY run) AS part FROM runs),
reached AS (SELECT *, sum(n) OVER (PARTITION BY channel, part ORDER BY run) AS so_far FROM stretches WHERE label IS NOT NULL),
heads AS (SELECT channel, part, coalesce(min(CASE WHEN so_far >= 3 THEN run END), max(run)) AS head FROM reached GROUP BY 1, 2),
named AS (
  SELECT r.channel, r.run, coalesce(last_value(CASE WHEN r.run = h.head OR (r.run > h.head AND r.n >= 3) THEN r.label END IGNORE NULLS) OVER (PARTITION BY r.channel, r.part ORDER BY r.run), max(CASE WHEN r.run = h.head THEN r.label END) OVER (PARTITION BY r.channel, r.part)) AS label
  FROM reached r JOIN heads h USING (channel, part)),
labels AS (SELECT b.channel, b.idx, m.label FROM numbered b LEFT JOIN named m USING (channel, run)),
followed AS (SELECT *, lag(label) OVER (PARTITION BY channel ORDER BY idx) AS was FROM labels),
switches AS (SELECT idx, CAST(sum(CASE WHEN label <> was THEN 1 ELSE 0 END) AS BIGINT) AS n_changed FROM followed GROUP BY 1)
"""
)
BLOCKS = (
    REGIMES
    + """,
final AS (SELECT max(idx) + 1 AS n FROM labels),
cuts AS (SELECT 24 AS a UNION SELECT idx FROM switches WHERE n_changed >= 2 AND idx > 24),
spans AS (SELECT a, lead(a, 1, n) OVER (ORDER BY a) AS b FROM cuts, final WHERE n > 25),
grown AS (SELECT *, sum(b - a) OVER (ORDER BY a) AS so_far FROM spans),
start AS (SELECT coalesce(min(CASE WHEN so_far >= 6 THEN a END), max(a)) AS head FROM grown),
firsts AS (SELECT a FROM spans, start WHERE a = 24 OR (a > head AND b - a >= 6)),
blocks AS (SELECT row_number() OVER (ORDER BY a) - 1 AS block_id, CAST(a AS BIGINT) AS start_idx, CAST(lead(a, 1, n) OVER (ORDER BY a) - 1 AS BIGINT) AS end_idx FROM firsts, final)
"""
)
#: The four predictors over known values. The regression of least norm where it isn't unique: points on a line, or all at one place.
BOARD = (
    SIGNAL
    + """,
y AS (SELECT channel, s AS y, row_number() OVER (PARTITION BY channel ORDER BY idx) AS p, count(*) OVER (PARTITION BY channel) AS size FROM sig WHERE s IS NOT NULL),
x AS (SELECT *, lag(y, 1) OVER o AS x1, lag(y, 2) OVER o AS x2, lag(y, 3) OVER o AS x3 FROM y WHERE size >= 8 WINDOW o AS (PARTITION BY channel ORDER BY p)),
whole AS (SELECT *, CASE WHEN p > 2 THEN y END AS t, CASE WHEN p > 2 THEN x1 END AS a, CASE WHEN p > 2 THEN x2 END AS b FROM x),
m AS (
  SELECT *, avg(t) OVER f AS my, avg(a) OVER f AS ma, avg(b) OVER f AS mb, covar_pop(t, a) OVER f AS ya, covar_pop(t, b) OVER f AS yb, covar_pop(a, b) OVER f AS ab, var_pop(a) OVER f AS va, var_pop(b) OVER f AS vb
  FROM whole WINDOW f AS (PARTITION BY channel ORDER BY p ROWS BETWEEN 22 PRECEDING AND 1 PRECEDING)),
spread AS (SELECT *, va > 1e-14 * (1 + ma * ma) AS sa, vb > 1e-14 * (1 + mb * mb) AS sb FROM m),
line AS (SELECT *, CASE WHEN sa THEN 1 ELSE 0 END AS wa, CASE WHEN NOT sa THEN 1 WHEN sb THEN ab / va ELSE 0 END AS wb, CASE WHEN sa THEN ya / va WHEN sb THEN yb / vb END AS slope, 1 + ma * ma + mb * mb AS uu, 1 + ma * x1 + mb * x2 AS uq FROM spread),
flat AS (SELECT *, wa * wa + wb * wb AS ww, wa * ma + wb * mb AS uw, wa * x1 + wb * x2 AS wq FROM line),
errors AS (
  SELECT channel, p, abs(y - x1) AS e0, abs(y - (2 * x1 - x2)) AS e1, abs(y - (3 * x1 - 3 * x2 + x3)) AS e2,
    abs(y - CASE WHEN p < 4 THEN NULL
      WHEN va * vb - ab * ab > 1e-12 * va * vb AND sa AND sb THEN my + (ya * vb - yb * ab) / (va * vb - ab * ab) * (x1 - ma) + (yb * va - ya * ab) / (va * vb - ab * ab) * (x2 - mb)
      WHEN sa OR sb THEN ((my * ww - slope * uw) * uq + (slope * uu - my * uw) * wq) / (uu * ww - uw * uw) ELSE my * uq / uu END) AS e3 FROM flat),
long AS (SELECT channel, unnest(['level', 'velocity', 'acceleration', 'local_ar2']) AS predictor, unnest([e0, e1, e2, e3]) AS e FROM errors)
"""
)
VALUE = "CASE eq_type WHEN 'linear' THEN L + c * ({t}) WHEN 'harmonic' THEN L + A * cos(2 * pi() / 24 * ({t})) + B * sin(2 * pi() / 24 * ({t})) ELSE L END"
VECTORS = """
pts AS (SELECT vec_id AS id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
protos AS (SELECT label AS pattern_id, pos, avg(x) AS p FROM pts GROUP BY 1, 2),
dist AS (SELECT id, pattern_id, round(sum((x - p) * (x - p)), 9) AS d2 FROM pts JOIN protos USING (pos) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, pattern_id) AS r FROM dist),
near AS (SELECT a.id, a.pattern_id, sqrt(a.d2) AS distance, sqrt(b.d2) AS second_distance FROM ranked a LEFT JOIN ranked b ON b.id = a.id AND b.r = 2 WHERE a.r = 1)
"""


def r(name: str, places: int = 6, expr: str | None = None) -> str:
    return f"CAST(round(CAST(({expr or name}) AS DECIMAL(38, 12)), {places}) AS DOUBLE) AS {name}"


def rs(names: str, places: int = 6) -> str:
    return ", ".join(r(n, places) for n in names.split())


FRAME = "OVER (PARTITION BY channel ORDER BY idx ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING)"


def _delta(k: int) -> str:
    return f"coalesce(v[len(v)] - CASE WHEN len(v) > {k} THEN v[len(v) - {k}] ELSE v[1] END, 0)"


def _lag_corr() -> str:
    """Correlations of all lags by plain joins of a window's rows, lags in the order that breaks ties."""
    return (
        SIGNAL
        + WINDOWS
        + """,
ab AS (SELECT l.channel AS a_ch, q.channel AS b_ch FROM (SELECT DISTINCT channel FROM sig) l JOIN (SELECT DISTINCT channel FROM sig) q ON l.channel < q.channel),
lags AS (SELECT k AS lag, CASE WHEN k = 0 THEN 0 WHEN k > 0 THEN 2 * k - 1 ELSE -2 * k END AS ord FROM generate_series(-6, 6) g(k)),
cells AS (
  SELECT w.window_id, ab.a_ch, ab.b_ch, g.lag, g.ord, x.s AS a, y.s AS b
  FROM win w CROSS JOIN ab CROSS JOIN lags g JOIN sig x ON x.channel = ab.a_ch AND x.idx BETWEEN w.window_id AND w.window_id + 23
  JOIN sig y ON y.channel = ab.b_ch AND y.idx = x.idx - g.lag AND y.idx BETWEEN w.window_id AND w.window_id + 23
  WHERE x.s IS NOT NULL AND y.s IS NOT NULL),
sums AS (SELECT window_id, a_ch, b_ch, lag, ord, count(*)::DOUBLE AS n, sum(a) AS sa, sum(b) AS sb, sum(a * a) AS saa, sum(b * b) AS sbb, sum(a * b) AS sab FROM cells GROUP BY 1, 2, 3, 4, 5),
rr AS (
  SELECT *, round(CASE WHEN n < 2 OR saa - sa * sa / n <= 1e-12 OR sbb - sb * sb / n <= 1e-12 THEN 0.0 ELSE (sab - sa * sb / n) / sqrt((saa - sa * sa / n) * (sbb - sb * sb / n)) END, 9) AS r FROM sums),
best AS (SELECT window_id, a_ch, b_ch, arg_max(r, (abs(r), -ord)) AS lag_correlation, max(CASE WHEN lag = 0 THEN r END) AS correlation FROM rr GROUP BY 1, 2, 3),
slopes AS (SELECT w.window_id, x.channel, avg(abs(x.d1)) AS m FROM win w JOIN sig x ON x.idx BETWEEN w.window_id AND w.window_id + 23 GROUP BY 1, 2)
SELECT w.window_id, ab.a_ch, ab.b_ch, """
        + r("correlation", 5, "coalesce(b.correlation, 0)")
        + ", "
        + r("lag_correlation", 5, "coalesce(b.lag_correlation, 0)")
        + ", "
        + r("slope_ratio", 5, "coalesce(p.m / nullif(q.m, 0), 0)")
        + """
FROM win w CROSS JOIN ab LEFT JOIN best b ON b.window_id = w.window_id AND b.a_ch = ab.a_ch AND b.b_ch = ab.b_ch
LEFT JOIN slopes p ON p.window_id = w.window_id AND p.channel = ab.a_ch LEFT JOIN slopes q ON q.window_id = w.window_id AND q.channel = ab.b_ch"""
    )


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["hourly_channel_grid"] = f"WITH {GRID} SELECT channel, idx, ts, {r('x')} FROM grid"
    q["quality_mask"] = f"""SELECT l_returnflag, count(CASE WHEN l_linenumber <= 2 THEN l_extendedprice END) AS n_valid, count(*) AS n,
      {r("mean_valid", 4, "avg(CASE WHEN l_linenumber <= 2 THEN l_extendedprice END)")} FROM lineitem GROUP BY 1"""
    q["date_slice"] = f"SELECT o_orderpriority, count(*) AS n, {r('mean_price', 4, 'avg(o_totalprice)')} FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' GROUP BY 1"
    q["long_form"] = f"WITH {GRID} SELECT channel, idx, {r('x')} FROM grid WHERE x IS NOT NULL"
    q["rolling_mean"] = f"WITH {SIGNAL} SELECT channel, idx, {r('s')} FROM sig"
    q["differences"] = f"WITH {SIGNAL} SELECT channel, idx, {rs('d1 d2')} FROM sig"
    filled = """, marks AS (
      SELECT channel, idx, x, last_value(CASE WHEN x IS NOT NULL THEN idx END IGNORE NULLS) OVER b AS i0, last_value(x IGNORE NULLS) OVER b AS x0,
        first_value(CASE WHEN x IS NOT NULL THEN idx END IGNORE NULLS) OVER a AS i1, first_value(x IGNORE NULLS) OVER a AS x1
      FROM grid WINDOW b AS (PARTITION BY channel ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY channel ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
      full_x AS (SELECT channel, idx, coalesce(x, CASE WHEN i0 IS NOT NULL AND i1 IS NOT NULL THEN x0 + (x1 - x0) * (idx - i0) / (i1 - i0) END, x0, x1) AS f FROM marks)"""
    q["linear_interp"] = f"WITH {GRID} {filled} SELECT channel, idx, {r('filled', 6, 'f')} FROM full_x"
    q["savgol"] = f"""WITH {GRID} {filled}, ends AS (SELECT channel, max(idx) + 1 AS n FROM full_x GROUP BY 1),
      mids AS (SELECT e.channel, e.n, p.idx, greatest(3, least(e.n - 4, p.idx)) AS mid FROM ends e JOIN full_x p USING (channel)),
      fit AS (
        SELECT m.channel, m.idx, m.idx - m.mid AS u, sum(y.f * CASE abs(y.idx - m.mid) WHEN 0 THEN 7 WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE -2 END) / 21 AS p0, sum(y.f * (y.idx - m.mid)) / 28 AS p1,
          sum(y.f * CASE abs(y.idx - m.mid) WHEN 0 THEN -4 WHEN 1 THEN -3 WHEN 2 THEN 0 ELSE 5 END) / 84 AS p2
        FROM mids m JOIN full_x y ON y.channel = m.channel AND y.idx BETWEEN m.mid - 3 AND m.mid + 3 GROUP BY 1, 2, 3)
      SELECT channel, idx, {r("s", 6, "p0 + p1 * u + p2 * u * u")} FROM fit"""
    q["extrema_events"] = f"WITH {EXTREMA} SELECT channel, idx, sign, {rs('amplitude value first_diff second_diff')} FROM extrema"
    q["peak_events"] = f"WITH {PEAKS} SELECT channel, idx, sign, {rs('value prominence width rise_slope fall_slope asymmetry left_base right_base')}, left_idx, right_idx FROM peaks"
    q["channel_thresholds"] = f"WITH {GRID} SELECT channel, {r('upper', 6, 'coalesce(quantile_cont(x, 0.9), 0)')}, {r('lower', 6, 'coalesce(quantile_cont(x, 0.1), 0)')} FROM grid GROUP BY 1"
    q["window_intra"] = f"""WITH {EXTREMA} {WINDOWS},
      cells AS (SELECT w.window_id, s.channel, s.idx, s.s, s.d2, e.sign, e.amplitude FROM win w JOIN sig s ON s.idx BETWEEN w.window_id AND w.window_id + 23 LEFT JOIN extrema e ON e.channel = s.channel AND e.idx = s.idx),
      agg AS (SELECT window_id, channel, list(s ORDER BY idx) FILTER (s IS NOT NULL) AS v, arg_max(d2, idx) FILTER (d2 IS NOT NULL) AS last_d2, avg(s) AS mean, var_pop(s) AS variance, sum(s) AS total, max(s) AS high, min(s) AS low,
        count(sign)::DOUBLE AS n_ext, sum(amplitude) AS amp FROM cells GROUP BY 1, 2)
      SELECT window_id, channel, {r("current_value", 6, "coalesce(v[len(v)], 0)")}, {r("delta_1", 6, _delta(1))}, {r("delta_6", 6, _delta(6))}, {r("delta_24", 6, _delta(24))}, {r("second_diff", 6, "coalesce(last_d2, 0)")},
        {r("mean", 6, "coalesce(mean, 0)")}, {r("variance", 6, "coalesce(variance, 0)")}, {r("integral", 6, "coalesce(total, 0)")}, {r("max", 6, "coalesce(high, 0)")}, {r("min", 6, "coalesce(low, 0)")},
        {r("range", 6, "coalesce(high - low, 0)")}, n_ext AS extrema_count, {r("extrema_amplitude_sum", 6, "coalesce(amp, 0)")} FROM agg"""
    q["window_hazard"] = f"""WITH {PEAKS} {WINDOWS}, th AS (SELECT channel, coalesce(quantile_cont(x, 0.9), 0) AS u, coalesce(quantile_cont(x, 0.1), 0) AS l FROM grid GROUP BY 1),
      joint AS (SELECT g.idx, max(CASE WHEN g.channel = 'purchase' AND coalesce(x, 0) >= u THEN 1 ELSE 0 END) * max(CASE WHEN g.channel = 'view' AND coalesce(x, 0) >= u THEN 1 ELSE 0 END) AS j FROM grid g JOIN th USING (channel) GROUP BY 1),
      agg AS (
        SELECT w.window_id, g.channel, count(p.sign)::DOUBLE AS n_peaks, max(p.value) AS mv, avg(p.prominence) AS ap, max(p.prominence) AS mp, avg(p.width) AS aw, max(p.width) AS mw, max(p.rise_slope) AS mr,
          coalesce(sum(CASE WHEN g.x > u THEN 1.0 END), 0)::DOUBLE AS dur, coalesce(sum(CASE WHEN g.x IS NOT NULL THEN greatest(g.x - u, 0) END), 0) AS up, coalesce(sum(CASE WHEN g.x IS NOT NULL THEN greatest(l - g.x, 0) END), 0) AS dn, max(j)::DOUBLE AS j
        FROM win w JOIN grid g ON g.idx BETWEEN w.window_id AND w.window_id + 23 JOIN th USING (channel) JOIN joint ON joint.idx = g.idx LEFT JOIN peaks p ON p.channel = g.channel AND p.idx = g.idx GROUP BY 1, 2)
      SELECT window_id, channel, n_peaks, {r("max_peak_value", 6, "coalesce(mv, 0)")}, {r("mean_prominence", 6, "coalesce(ap, 0)")}, {r("max_prominence", 6, "coalesce(mp, 0)")}, {r("mean_width", 6, "coalesce(aw, 0)")},
        {r("max_width", 6, "coalesce(mw, 0)")}, {r("max_rise_slope", 6, "coalesce(mr, 0)")}, dur AS duration_over, {r("upper_tail", 6, "up")}, {r("lower_tail", 6, "dn")}, {r("cumulative_risk", 6, "up + dn + dur")},
        CASE WHEN dur > 0 OR up + dn + dur > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hazard_flag, j AS compound_flag FROM agg"""
    bridge = "bridge AS (SELECT w.window_id, e.* FROM win w JOIN extrema e ON e.idx BETWEEN w.window_id AND w.window_id + 23)"
    q["event_window_bridge"] = f"WITH {EXTREMA} {WINDOWS}, {bridge} SELECT window_id, channel, sign, count(*) AS n_events, min(idx) AS first_idx, max(idx) AS last_idx FROM bridge GROUP BY 1, 2, 3"
    q["window_time_block"] = f"""WITH {PEAKS.replace(SIGNAL, EXTREMA)} {WINDOWS}, {bridge}, gaps AS (SELECT *, (idx - lag(idx) OVER (PARTITION BY window_id ORDER BY idx, channel))::DOUBLE AS gap FROM bridge),
      a AS (SELECT window_id, avg(gap) AS g, var_pop(gap) AS vg, count(*) AS n, avg((idx - window_id) / 23) AS place FROM gaps GROUP BY 1),
      b AS (SELECT w.window_id, avg(p.width) AS aw, max(p.width) AS mw FROM win w JOIN peaks p ON p.idx BETWEEN w.window_id AND w.window_id + 23 GROUP BY 1)
      SELECT window_id, {r("mean_gap", 6, "coalesce(g, 0)")}, {r("var_gap", 6, "coalesce(vg, 0)")}, {r("mean_width", 6, "coalesce(aw, 0)")}, {r("max_width", 6, "coalesce(mw, 0)")}, coalesce(n, 0) AS n_events, {r("mean_place", 6, "coalesce(place, 0)")}
      FROM a FULL JOIN b USING (window_id)"""
    q["window_pairs"] = f"WITH {_lag_corr()}"
    q["sync_extrema"] = f"""WITH {EXTREMA} {WINDOWS}, {bridge}, hit AS (
        SELECT a.window_id, a.channel AS a_ch, b.channel AS b_ch, a.idx, min(abs(a.idx - b.idx)) AS lag FROM bridge a JOIN bridge b ON b.window_id = a.window_id AND a.channel < b.channel AND abs(a.idx - b.idx) <= 1 GROUP BY 1, 2, 3, 4)
      SELECT window_id, a_ch, b_ch, count(*) AS sync_count, {r("mean_event_lag", 6, "avg(lag)")} FROM hit GROUP BY 1, 2, 3"""
    steps = "steps AS (SELECT *, lag(s) OVER w AS level, 2 * lag(s) OVER w - lag(s, 2) OVER w AS velocity, 3 * lag(s) OVER w - 3 * lag(s, 2) OVER w + lag(s, 3) OVER w AS acceleration FROM sig WINDOW w AS (PARTITION BY channel ORDER BY idx))"
    q["one_step_predictors"] = f"WITH {SIGNAL}, {steps} SELECT channel, idx, {rs('level velocity acceleration')} FROM steps"
    q["predictor_scoreboard"] = f"""WITH {SIGNAL}, {steps}, e AS (SELECT channel, s, unnest(['level', 'velocity', 'acceleration']) AS predictor, unnest([level, velocity, acceleration]) AS p FROM steps
        WHERE s IS NOT NULL AND level IS NOT NULL AND velocity IS NOT NULL AND acceleration IS NOT NULL)
      SELECT channel, predictor, count(*) AS n, {r("mae", 6, "avg(abs(s - p))")} FROM e GROUP BY 1, 2"""
    q["circular_error"] = f"""WITH {GRID}, deg AS (SELECT channel, idx, x * 7 - 360 * floor(x * 7 / 360) AS deg FROM grid), was AS (SELECT *, lag(deg) OVER (PARTITION BY channel ORDER BY idx) AS was FROM deg)
      SELECT channel, {r("mean_error", 6, "avg(least(abs(deg - was), 360 - abs(deg - was)))")} FROM was WHERE deg IS NOT NULL AND was IS NOT NULL GROUP BY 1"""
    q["history_frames"] = f"""WITH {GRID} {WINDOWS} {ONE} SELECT window_id, concat_ws(',', window_id - 3, window_id - 2, window_id - 1, window_id) AS history_ids FROM one WHERE window_id >= 3"""
    q["target_lookup"] = f"""WITH {GRID} {WINDOWS} {ONE}, t AS (SELECT a.window_id, b.window_id AS target FROM one a CROSS JOIN generate_series(0, 23) g(k) JOIN one b ON b.start_idx = a.start_idx + 24 + k)
      SELECT window_id, string_agg(target, ',' ORDER BY target) AS target_ids FROM t GROUP BY 1 HAVING count(*) = 24"""
    q["forward_asof_target"] = f"""WITH {GRID} {WINDOWS} {ONE}, p AS (SELECT *, row_number() OVER (ORDER BY start_idx) - 1 AS pos FROM one),
      f AS (SELECT a.window_id, greatest(min(b.pos), a.pos + 1) AS first FROM p a JOIN p b ON b.start_idx >= a.end_idx + 24 GROUP BY 1, a.pos),
      t AS (SELECT f.window_id, p.window_id AS target FROM f JOIN p ON p.pos BETWEEN f.first AND f.first + 2)
      SELECT window_id, string_agg(target, ',' ORDER BY target) AS target_ids FROM t GROUP BY 1 HAVING count(*) = 3"""
    q["sequence_samples"] = f"""WITH {GRID} {WINDOWS} {ONE},
      h AS (SELECT a.window_id, b.window_id AS id, 'h' AS side, b.block_id FROM one a JOIN one b ON b.start_idx BETWEEN a.start_idx - 3 AND a.start_idx),
      t AS (SELECT a.window_id, b.window_id AS id, 't' AS side, b.block_id FROM one a JOIN one b ON b.start_idx BETWEEN a.start_idx + 24 AND a.start_idx + 29),
      u AS (SELECT *, block_id AS pattern FROM (SELECT * FROM h UNION ALL SELECT * FROM t))
      SELECT window_id AS source_window_id, string_agg(id, ',' ORDER BY id) FILTER (side = 'h') AS history_ids, string_agg(id, ',' ORDER BY id) FILTER (side = 't') AS target_ids,
        string_agg(pattern, ',' ORDER BY id) FILTER (side = 'h') AS history_patterns, string_agg(pattern, ',' ORDER BY id) FILTER (side = 't') AS target_patterns
      FROM u GROUP BY 1 HAVING count(*) FILTER (side = 'h') = 4 AND count(*) FILTER (side = 't') = 6 AND min(block_id) = max(block_id)"""
    q["chronological_split"] = f"""WITH {GRID} {WINDOWS} {ONE}, p AS (SELECT window_id, row_number() OVER (ORDER BY start_idx) - 1 AS pos, count(*) OVER () AS n FROM one),
      c AS (SELECT *, greatest(1, least(n - 1, floor(n * 0.7))) AS a, greatest(1, least(n - 1, floor(n * 0.85))) AS z FROM p)
      SELECT window_id, pos, CASE WHEN pos < a THEN 'train' WHEN pos < (CASE WHEN z <= a THEN least(n - 1, a + 1) ELSE z END) THEN 'validation' ELSE 'test' END AS split FROM c"""
    plain = BACKTEST.replace("a.x + (t.upper - a.x) * h / 240 - b.x AS e", "a.x - b.x AS e")
    q["persistence_backtest"] = f"WITH {plain} SELECT channel, coalesce(horizon, 0) AS horizon, n, {rs('mae rmse')}, baseline_n, {rs('baseline_mae baseline_rmse')} FROM stats"
    q["evaluation_payload"] = f"WITH {BACKTEST} SELECT coalesce(horizon, 0) AS horizon, count(*) AS n_channels, {r('mae', 6, 'avg(mae)')}, {r('rmse', 6, 'avg(rmse)')} FROM stats WHERE n > 0 AND coalesce(horizon, 0) <= 5 GROUP BY 1"
    q["longest_peaks"] = f"WITH {PEAKS} SELECT channel, idx, sign, {r('width')} FROM peaks ORDER BY peaks.width DESC, channel, idx LIMIT 20"
    q["segment_histories"] = f"""WITH {LINES}, reach AS (SELECT channel, min(start_idx) + 120 AS a, max(start_idx) - 120 AS z FROM segs GROUP BY 1 HAVING max(start_idx) - min(start_idx) >= 240),
      c AS (SELECT channel, unnest(generate_series(a, z)) AS centre FROM reach),
      t AS (SELECT c.channel, centre, list(segment_id ORDER BY start_idx) AS ids FROM c JOIN segs s ON s.channel = c.channel AND s.start_idx >= centre - 120 AND s.start_idx < centre GROUP BY 1, 2),
      h AS (SELECT c.channel, centre, count(*) AS n FROM c JOIN segs s ON s.channel = c.channel AND s.start_idx >= centre AND s.start_idx < centre + 120 GROUP BY 1, 2)
      SELECT channel, CAST(centre AS BIGINT) AS centre, CAST(least(len(coalesce(ids, [])), 4) AS BIGINT) AS n_tail, CAST(least(coalesce(h.n, 0), 4) AS BIGINT) AS n_head, ids[greatest(len(ids) - 3, 1)] AS first_segment,
        CAST(CASE WHEN ids IS NOT NULL THEN 3 END AS BIGINT) AS last_slot FROM c LEFT JOIN t USING (channel, centre) LEFT JOIN h USING (channel, centre)"""
    q["placeholder_decode"] = f"""WITH b AS ({q["window_time_block"]}) SELECT window_id, CAST(greatest(round_even(mean_gap * 3, 0), 1) AS BIGINT) AS window_length_steps, CAST(greatest(round_even(var_gap, 0), 1) AS BIGINT) AS forecast_horizon_steps,
      {r("mean_peak_width_steps", 5, "mean_width")}, CAST(greatest(round_even(n_events / 2, 0), 0) AS BIGINT) AS n_positions, {r("over", 5, "mean_place")} FROM b"""
    q["drift_backtest"] = f"WITH {BACKTEST} SELECT channel, coalesce(horizon, 0) AS horizon, n, {rs('mae rmse')}, baseline_n, {rs('baseline_mae baseline_rmse')} FROM stats"
    q["hourly_scoreboard"] = f"WITH {BACKTEST} SELECT coalesce(horizon, 0) AS horizon, count(*) AS n_channels, {r('mae', 6, 'avg(mae)')}, {r('rmse', 6, 'avg(rmse)')} FROM stats WHERE n > 0 GROUP BY 1"
    q["boundary_union"] = f"""WITH {EXTREMA}, b AS (SELECT DISTINCT channel, unnest([idx, idx + 1]) AS idx FROM extrema) SELECT idx, count(*) AS n_tables FROM b GROUP BY 1"""
    q["index_intersection"] = f"WITH {GRID} SELECT idx FROM grid GROUP BY 1 HAVING count(*) = count(x)"
    q["ensemble_stitch"] = f"""WITH {GRID}, th AS (SELECT channel, coalesce(quantile_cont(x, 0.9), 0) AS u, coalesce(quantile_cont(x, 0.1), 0) AS l FROM grid GROUP BY 1)
      SELECT channel, h AS horizon, count(*) AS n, {r("mean_prediction", 6, "avg(CASE WHEN h < 12 THEN x WHEN h < 24 THEN l ELSE u END)")} FROM grid JOIN th USING (channel) CROSS JOIN generate_series(1, 36) g(h) WHERE x IS NOT NULL GROUP BY 1, 2"""
    q["linear_fit_by_block"] = f"WITH {LINES} SELECT channel, block, n, {rs('mean intercept slope')} FROM fits"
    value = VALUE.format(t="g.idx - s.start_idx")
    q["equation_eval"] = f"WITH {LINES} SELECT g.channel, g.idx, s.segment_id, {r('actual', 6, 'g.x')}, {r('fitted', 6, value)} FROM grid g JOIN segs s ON s.channel = g.channel AND g.idx BETWEEN s.start_idx AND s.end_idx"
    q["segment_report"] = f"""WITH {LINES}
      SELECT eq_type, count(*) AS n, {r("mean_duration", 4, "avg(duration)")}, CAST(min(duration) AS BIGINT) AS min_duration, CAST(max(duration) AS BIGINT) AS max_duration, {r("mean_rms", 4, "avg(rms)")},
        {r("pct", 4, "100.0 * count(*) / (SELECT count(*) FROM segs)")} FROM segs GROUP BY ROLLUP (eq_type)"""
    q["segment_vectors"] = f"""WITH {LINES} SELECT channel, segment_id, eq_type, {r("L")}, {r("c")}, {r("A")}, {r("B")}, CAST(duration AS BIGINT) AS duration, {r("total", 6, "1 + L / 50 + c / 2 + A / 10 + B + 1")} FROM segs"""
    first, last = VALUE.format(t="0"), VALUE.format(t="23")
    q["decoded_series"] = f"""WITH {LINES}, ab AS (SELECT *, {first} AS v0, {last} AS v1 FROM segs),
      c AS (SELECT *, 10.0 + coalesce(sum(v1 - v0) OVER w, 0) AS carry, coalesce(sum(duration) OVER w, 0) AS base FROM ab WINDOW w AS (PARTITION BY channel ORDER BY segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT channel, CAST(base + k AS BIGINT) AS idx, {r("value", 6, f"{VALUE.format(t='k')} + carry - v0")} FROM c CROSS JOIN generate_series(0, 23) g(k) WHERE base + k < 200"""
    ahead = VALUE.format(t="g.idx - s.start_idx")
    q["extrapolated_errors"] = f"""WITH {LINES}, l AS (SELECT * FROM segs WHERE end_idx < (SELECT max(idx) FROM grid) - 47 QUALIFY row_number() OVER (PARTITION BY channel ORDER BY start_idx DESC) = 1)
      SELECT g.channel, count(*) AS n, {r("mae", 6, f"avg(abs(g.x - ({ahead})))")} FROM grid g JOIN l s ON s.channel = g.channel AND g.idx BETWEEN s.end_idx + 1 AND s.end_idx + 48 WHERE g.x IS NOT NULL GROUP BY 1"""
    cols = "l_quantity l_extendedprice l_discount l_tax".split()
    q["p90_scales"] = "SELECT " + ", ".join(r(c, 4, f"coalesce(quantile_cont(abs({c}), 0.9) FILTER (abs({c}) > 1e-6), 1.0)") for c in cols) + " FROM lineitem"
    q["robust_scale"] = f"""WITH {VECTORS}, s AS (SELECT pos, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS d FROM pts GROUP BY 1)
      SELECT CAST(pos AS INTEGER) AS pos, {r("center", 6, "m")}, {r("scale", 6, "CASE WHEN d > 1e-6 THEN d ELSE 1.0 END")} FROM s"""
    q["vector_norm_stats"] = f"WITH {VECTORS}, s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS d FROM pts GROUP BY 1) SELECT CAST(pos AS INTEGER) AS pos, {r('mean', 6, 'm')}, {r('std', 6, 'CASE WHEN d <= 1e-6 THEN 1.0 ELSE d END')} FROM s"
    q["time_features"] = f"""SELECT DISTINCT o_orderdate AS day, {r("doy_sin", 6, "sin(2 * pi() * dayofyear(o_orderdate) / 365)")}, {r("doy_cos", 6, "cos(2 * pi() * dayofyear(o_orderdate) / 365)")},
      {r("hour_sin", 6, "sin(2 * pi() * hour(o_orderdate) / 24)")}, {r("hour_cos", 6, "cos(2 * pi() * hour(o_orderdate) / 24)")} FROM orders"""
    q["running_duration_k"] = f"""WITH {PEAKS}, c AS (SELECT channel, sum(width) OVER w - width AS before, row_number() OVER w AS k FROM peaks WINDOW w AS (PARTITION BY channel ORDER BY idx)) SELECT channel, CAST(sum(CASE WHEN before < 48 AND k <= 48 THEN 1 ELSE 0 END) AS BIGINT) AS k FROM c GROUP BY 1"""
    q["next24_targets"] = f"""WITH {GRID}, k AS (SELECT channel, idx, x FROM grid WHERE x IS NOT NULL), t AS (
        SELECT a.channel, a.idx, b.idx - a.idx - 1 AS step, b.x - a.x AS delta, count(*) OVER (PARTITION BY a.channel, a.idx) AS n FROM k a JOIN k b ON b.channel = a.channel AND b.idx BETWEEN a.idx + 1 AND a.idx + 24)
      SELECT channel, idx, step, {r("delta")} FROM t WHERE n = 24"""
    intra = q["window_intra"]
    head, tail = intra.rsplit("SELECT window_id, channel, ", 1)
    bare = f"""coalesce(v[len(v)], 0) AS cur, {_delta(1)} AS e1, {_delta(6)} AS e6, {_delta(24)} AS e24, coalesce(last_d2, 0) AS d2, coalesce(mean, 0) AS mean, coalesce(high, 0) AS high, coalesce(low, 0) AS low FROM agg"""
    q["window_decode"] = f"""{head.rstrip()}, f AS (SELECT window_id, channel, {bare}),
      p AS (SELECT *, CAST(floor(window_id / 24) AS BIGINT) AS sample_id, (row_number() OVER (PARTITION BY floor(window_id / 24), channel ORDER BY window_id) - 1) / greatest(count(*) OVER (PARTITION BY floor(window_id / 24), channel) - 1, 1) AS p FROM f),
      w AS (SELECT *, cur + (0.5 * e1 + 0.3 * e6 / 6 + 0.2 * e24 / 24) * p + 0.5 * d2 * p * (1 - p) + 0.15 * (mean - cur) AS raw, greatest(0.05 * abs(high - low), 1e-6) AS m FROM p)
      SELECT sample_id, channel, window_id AS step, {r("value", 6, "CASE WHEN abs(high - low) <= 1e-8 THEN CASE WHEN abs(cur) <= 1e-8 THEN raw ELSE cur END ELSE least(greatest(raw, low - m), high + m) END")} FROM w"""
    q["interval_values"] = f"""WITH {GRID}, k AS (SELECT channel, CAST(idx AS DOUBLE) AS t, x AS v FROM grid WHERE x IS NOT NULL), a AS (SELECT channel, idx * 1.5::DOUBLE AS t FROM grid),
      n AS (SELECT a.channel, a.t, max(CASE WHEN k.t <= a.t THEN k.t END) AS t0, min(CASE WHEN k.t >= a.t THEN k.t END) AS t1 FROM a JOIN k USING (channel) GROUP BY 1, 2)
      SELECT n.channel, n.t, {r("v", 6, "CASE WHEN t0 IS NULL THEN q.v WHEN t1 IS NULL OR t0 = t1 THEN p.v ELSE p.v + (q.v - p.v) * (n.t - t0) / (t1 - t0) END")}
      FROM n LEFT JOIN k p ON p.channel = n.channel AND p.t = t0 LEFT JOIN k q ON q.channel = n.channel AND q.t = t1"""
    q["anchor_days"] = f"""WITH o AS (SELECT o_orderdate AS day, year(o_orderdate) AS year, abs(dayofyear(o_orderdate) - 60) AS off, sum(o_totalprice) AS total FROM orders GROUP BY 1)
      SELECT CAST(year AS BIGINT) AS year, day, CAST(off AS BIGINT) AS off, {r("total", 2)} FROM o WHERE off <= 7 QUALIFY row_number() OVER (PARTITION BY year ORDER BY off, day) = 1"""
    by = "CASE WHEN abs(range) > 1e-6 THEN abs(range) ELSE 1.0 END"
    scaled = {c: f"{c} / {by}" for c in "delta_1 delta_6 delta_24 second_diff max_peak_value mean_prominence max_prominence max_rise_slope".split()}
    scaled |= {"variance": f"variance / ({by} * {by})", "extrema_amplitude_sum": f"extrema_amplitude_sum / ({by} * greatest(events, 1))"}
    scaled |= {c: f"{c} / 24" for c in "extrema_count n_peaks mean_width max_width duration_over".split()} | {c: f"{c} / ({by} * 24)" for c in "upper_tail lower_tail cumulative_risk".split()}
    columns = ", ".join(r(c, 5, x) for c, x in scaled.items()) + ", " + rs("hazard_flag compound_flag", 5)
    q["scaled_features"] = f"""WITH a AS ({q["window_intra"]}), b AS ({q["window_hazard"]}), e AS (SELECT window_id, sum(extrema_count) AS events FROM a GROUP BY 1)
      SELECT window_id, channel, {columns} FROM a JOIN b USING (window_id, channel) JOIN e USING (window_id)"""
    q["scaled_pairs"] = f"""WITH a AS ({q["window_pairs"]}), b AS ({q["sync_extrema"]}) SELECT window_id, a_ch, b_ch, {rs("correlation lag_correlation", 4)}, {r("slope_ratio", 4, "tanh(slope_ratio)")},
      {r("sync_count", 4, "coalesce(sync_count, 0) / 24")}, {r("mean_event_lag", 4, "coalesce(mean_event_lag, 0) / 24")} FROM a LEFT JOIN b USING (window_id, a_ch, b_ch)"""
    q["label_lookup"] = f"""WITH {EXTREMA} {WINDOWS} {ONE}, l AS (SELECT w.window_id, count(*) AS k FROM win w JOIN extrema e ON e.sign = 'max' AND e.amplitude > 20 AND e.idx BETWEEN w.window_id AND w.window_id + 23 GROUP BY 1)
      SELECT block_id, coalesce(k, -1) AS pattern_id, count(*) AS n FROM one LEFT JOIN l USING (window_id) GROUP BY 1, 2"""
    q["nearest_prototype"] = f"WITH {VECTORS} SELECT id, pattern_id, {rs('distance second_distance', 5)} FROM near"
    q["lloyd_step"] = f"WITH {VECTORS} SELECT n.pattern_id, CAST(pos AS INTEGER) AS pos, {r('value', 6, 'avg(x)')}, count(*) AS n FROM pts JOIN near n USING (id) GROUP BY 1, 2"
    q["cluster_quality"] = f"""WITH {VECTORS}, b AS (SELECT pattern_id, count(*) AS n, sum(coalesce((second_distance - distance) / nullif(greatest(distance, second_distance), 0), 0)) AS s FROM near GROUP BY 1),
      o AS (SELECT count(*) AS n_clusters, sum(s) / sum(n) AS separation, min(n) / avg(n) AS balance FROM b) SELECT n_clusters, {rs("separation balance")}, {r("quality", 6, "separation * balance")} FROM o"""
    q["predictor_board"] = f"WITH {BOARD} SELECT channel, predictor, count(e) AS n, {r('mae', 6, 'avg(e)')} FROM long GROUP BY 1, 2"
    q["regime_labels"] = f"WITH {REGIMES} SELECT channel, idx, label FROM labels"
    q["switch_counts"] = f"WITH {REGIMES} SELECT idx, n_changed FROM switches"
    q["regime_blocks"] = f"WITH {BLOCKS} SELECT block_id, start_idx, end_idx FROM blocks"
    q["hierarchical_windows"] = f"""WITH {BLOCKS}, w AS (SELECT block_id, unnest(generate_series(start_idx, end_idx - 23)) AS start_idx FROM blocks WHERE end_idx - start_idx >= 23)
      SELECT block_id, start_idx, start_idx + 23 AS end_idx FROM w"""
    q["top_signatures"] = f"""WITH {BLOCKS}, own AS (SELECT b.block_id, b.end_idx - b.start_idx + 1 AS steps, l.channel || '=' || coalesce(l.label, 'none') AS part FROM blocks b JOIN labels l ON l.idx = b.start_idx),
      signatures AS (SELECT block_id, steps, string_agg(part, ',' ORDER BY part) AS signature FROM own GROUP BY 1, 2)
      SELECT signature, CAST(sum(steps) AS BIGINT) AS steps FROM signatures GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12"""
    q["label_shares"] = f"WITH {REGIMES}, n AS (SELECT channel, label, count(*) AS n FROM labels GROUP BY 1, 2) SELECT channel, label, n, {r('share', 6, 'n / sum(n) OVER (PARTITION BY channel)')} FROM n"
    q["observations_csv"] = f"""WITH e AS (SELECT date_trunc('minute', ts) AS ts, value, user_id % 4 AS f, CASE WHEN user_id % 5 < 4 THEN user_id % 5 END AS t, CASE WHEN event_id % 9 <> 0 THEN value * 2 END AS v
      FROM events QUALIFY row_number() OVER (PARTITION BY date_trunc('minute', ts) ORDER BY event_id) = 1)
      SELECT ts, {r("rainfall", 6, "CASE WHEN f <= 2 THEN value END")}, {r("temperature", 6, "CASE WHEN t <= 2 THEN v END")}, CAST(NULL AS DOUBLE) AS pressure, coalesce(f, -1) AS rain_quality, coalesce(t, -1) AS temp_quality FROM e"""
    q["history_json_lines"] = f"WITH {GRID} {WINDOWS} SELECT window_id, k AS place, window_id - 3 + k AS member_id FROM win, generate_series(0, 3) g(k) WHERE window_id >= 3"
    q["history_flat_csv"] = f"WITH {GRID} {WINDOWS} SELECT window_id, window_id AS start_idx, concat_ws(',', window_id - 3, window_id - 2, window_id - 1, window_id) AS history_ids FROM win WHERE window_id >= 3"
    q["stored_extrema"] = f"WITH {EXTREMA} SELECT channel, idx, sign, {r('amplitude')} FROM extrema WHERE sign = 'max'"
    hours = "h AS (SELECT event_type AS channel, date_trunc('hour', ts) AS ts, avg(value) AS x FROM events GROUP BY 1, 2), closed AS (SELECT h.* FROM h, (SELECT max(ts) AS last FROM events) m WHERE h.ts + INTERVAL 3 HOUR <= m.last)"
    q["streamed_hours"] = f"WITH {hours} SELECT channel, ts, {r('x')} FROM closed"
    q["streamed_once"] = q["streamed_hours"]
    q["streamed_extrema"] = f"""WITH {hours}, y AS (SELECT channel, ts, round(x, 8) AS x FROM closed),
      d AS (SELECT channel, ts, lag(ts, 2) OVER o AS t0, lead(ts) OVER o AS t1, lag(x) OVER o - lag(x, 2) OVER o AS p, x - lag(x) OVER o AS c, lead(x) OVER o - x AS n FROM y WINDOW o AS (PARTITION BY channel ORDER BY ts))
      SELECT channel, ts, CASE WHEN p < c THEN 'max' ELSE 'min' END AS sign, {r("amplitude", 5, "abs(c - (p + n) / 2)")}, {r("first_diff", 5, "c")} FROM d WHERE t1 - t0 = INTERVAL 3 HOUR AND ((p < c AND c >= n) OR (p > c AND c <= n))"""
    q["reindexed_steps"] = f"""WITH {GRID}, n AS (SELECT channel, ts, x, row_number() OVER (PARTITION BY channel ORDER BY ts) - 1 AS idx FROM grid WHERE x IS NOT NULL AND idx >= 240)
      SELECT channel, ts, idx, {r("x")} FROM n WHERE idx < 200"""
    q["window_range"] = f"WITH {GRID} {WINDOWS} {ONE} SELECT window_id AS pos, window_id, start_idx, block_id FROM one WHERE window_id >= 100 AND window_id < 300"
    q["seed_history"] = f"""WITH t AS (SELECT o_orderpriority, o_orderdate AS day, avg(o_totalprice) AS mean_price FROM orders WHERE o_orderdate < '1997-01-01' GROUP BY 1, 2),
      k AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY day DESC) AS back FROM t QUALIFY back <= 14)
      SELECT o_orderpriority, day, row_number() OVER (PARTITION BY o_orderpriority ORDER BY day) - 1 AS place, {r("mean_price", 4)} FROM k"""
    q["padded_segment_targets"] = f"""WITH {LINES}, t AS (SELECT channel, segment_id, L + c + A + duration / 24 AS total, row_number() OVER (PARTITION BY channel ORDER BY segment_id) AS p, count(*) OVER (PARTITION BY channel) AS n FROM segs)
      SELECT a.channel, a.segment_id, least(a.n - a.p, 48) AS n_valid, g.k - 1 AS step, {r("total", 6, "coalesce(b.total, 0)")} FROM t a CROSS JOIN generate_series(1, 48) g(k) LEFT JOIN t b ON b.channel = a.channel AND b.p = a.p + g.k"""
    q["equation_counts"] = f"WITH {LINES}, n AS (SELECT channel, eq_type, count(*) AS n FROM segs GROUP BY 1, 2) SELECT channel, eq_type, n, {r('share', 6, 'n / sum(n) OVER (PARTITION BY channel)')} FROM n"
    q["boundary_synchrony"] = f"WITH {EXTREMA}, k AS (SELECT idx, count(DISTINCT channel) AS n_channels FROM extrema GROUP BY 1) SELECT n_channels, count(*) AS n FROM k GROUP BY 1"
    q["decoded_hazards"] = f"""WITH h AS ({q["window_hazard"]}), l AS (UNPIVOT h ON COLUMNS(* EXCLUDE (window_id, channel)) INTO NAME feature VALUE value), v AS (SELECT channel, feature, window_id, CAST(value AS DOUBLE) AS value FROM l),
      top AS (SELECT max(window_id) AS n FROM v), a AS (SELECT DISTINCT channel, feature, window_id * 1.5::DOUBLE AS t FROM v),
      asked AS (SELECT channel, feature, t, least(floor(t), n) AS t0, least(ceil(t), n) AS t1 FROM a, top)
      SELECT a.channel, a.feature, a.t, {r("value", 5, "p.value + (q.value - p.value) * (a.t - a.t0) / CASE WHEN a.t1 > a.t0 THEN a.t1 - a.t0 ELSE 1 END")}
      FROM asked a JOIN v p ON p.channel = a.channel AND p.feature = a.feature AND p.window_id = a.t0 JOIN v q ON q.channel = a.channel AND q.feature = a.feature AND q.window_id = a.t1"""
    return q
