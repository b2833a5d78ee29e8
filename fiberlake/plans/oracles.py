"""DuckDB SQL for the queries that SQL can express, by name."""

from __future__ import annotations

from .oracles_signal import made

ORACLE: dict[str, str] = made()

# the stand-in tables
E = """e AS (SELECT vec_id AS t, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS channel,
  CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"""
Q = E + """, q AS (SELECT t, channel, value * value AS value FROM e)"""
P = """p AS (SELECT CAST(s_suppkey AS INTEGER) AS channel_id, CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS INTEGER) AS pos,
  CAST(55.3 AS DOUBLE) + s_suppkey * CAST(2e-5 AS DOUBLE) AS lat, CAST(11.0 AS DOUBLE) + s_suppkey * CAST(1e-4 AS DOUBLE) AS lon FROM supplier),
ref AS (SELECT avg(lat) AS rlat, avg(lon) AS rlon FROM p)"""
A = """a AS (SELECT event_id AS ord, ts, event_type AS kind, user_id AS mmsi, value AS sog,
  CAST(55.3 AS DOUBLE) + ((event_id * 37) % 1000) / CAST(10000 AS DOUBLE) AS lat,
  CAST(11.0 AS DOUBLE) + ((event_id * 61) % 1000) / CAST(10000 AS DOUBLE) AS lon FROM events)"""
M = "CAST(111320 AS DOUBLE)"


def rnd(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + 0.0)"


def metres(lat: str, lon: str, lat2: str, lon2: str, rlat: str = "rlat", rlon: str = "rlon") -> str:
    """Distance on the plane at (rlat, rlon)."""
    x = f"(({lon} - {rlon}) * {M} * cos(radians({rlat})) - ({lon2} - {rlon}) * {M} * cos(radians({rlat})))"
    y = f"(({lat} - {rlat}) * {M} - ({lat2} - {rlat}) * {M})"
    return f"sqrt({x} * {x} + {y} * {y})"


NEAR = f"""{P}, {A},
firsts AS (SELECT * FROM a WHERE kind IN ('click', 'view') QUALIFY row_number() OVER (PARTITION BY mmsi, ts ORDER BY ord) = 1),
near AS (SELECT firsts.*, p.pos, p.channel_id, {metres('firsts.lat', 'firsts.lon', 'p.lat', 'p.lon')} AS d FROM firsts, p, ref
  QUALIFY row_number() OVER (PARTITION BY ord ORDER BY d, p.pos) = 1),
nr AS (SELECT * FROM near WHERE d <= 2000)"""
CROSS = f"""{NEAR}, cr AS (SELECT * FROM nr QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY d, ord) = 1)"""
BASE = f"""{Q},
med AS (SELECT channel, median(value) AS m FROM q GROUP BY channel),
base AS (SELECT channel, m AS floor, greatest(median(abs(value - m)) * 1.4826, 1e-6 * greatest(m, 1)) AS scale FROM q JOIN med USING (channel) GROUP BY channel, m),
z AS (SELECT t // 50 AS file, t, channel, (value - floor) / scale AS score FROM q JOIN base USING (channel))"""
TRIG = f"{BASE}, trig AS (SELECT *, score > 6 AS triggered FROM z)"
ZS = "zs AS (SELECT t, channel, (value - avg(value) OVER w) / (CASE WHEN stddev_pop(value) OVER w = 0 THEN 1 ELSE stddev_pop(value) OVER w END) AS z FROM {0} WINDOW w AS (PARTITION BY {1}))"

# reducers
_REDUCE = {"rms": "sqrt(avg(value * value))", "std": "stddev_pop(value)", "mean": "avg(value)", "abs_mean": "avg(abs(value))", "max": "max(abs(value))"}
for _name, _agg in _REDUCE.items():
    ORACLE[f"reduce_{_name}"] = f"WITH {E} SELECT t // 50 AS file, channel, {rnd(_agg)} AS value FROM e GROUP BY ALL"
ORACLE["energy_mean_square"] = f"WITH {Q} SELECT t AS vec_id, {rnd('avg(value)', 8)} AS value FROM q GROUP BY t"
ORACLE["reduce_signals"] = f"WITH {E} SELECT t AS vec_id, {', '.join(f'{rnd(a)} AS {n}' for n, a in (_REDUCE | {'mean_square': 'avg(value * value)'}).items())} FROM e GROUP BY t"
ORACLE["image_from_events"] = f"SELECT CAST(dayofyear(ts) AS INTEGER) AS t, CAST(user_id % 8 AS INTEGER) AS channel, {rnd('avg(value)')} AS value FROM events GROUP BY ALL"

# statistics
_STATS = """{0}, base AS (SELECT channel, median(value) AS median, avg(value) AS mean, stddev_pop(value) AS std,
  quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.99) AS p99 FROM q GROUP BY channel),
lim AS (SELECT CASE WHEN median(median) > 0 THEN 0.01 * median(median) ELSE 0 END AS low FROM base),
cap AS (SELECT {1} AS high FROM q),
more AS (SELECT channel, median(abs(value - median)) * 1.4826 AS mad, avg(CASE WHEN value < low THEN 1.0 ELSE 0.0 END) AS dropout_frac,
  avg(CASE WHEN value > high THEN 1.0 ELSE 0.0 END) AS saturation_frac,
  avg(CASE WHEN value BETWEEN median / 2.0 AND median * 2.0 THEN 1.0 ELSE 0.0 END) AS persistence
  FROM q JOIN base USING (channel), lim, cap GROUP BY channel)"""
_AUTO = _STATS.format(Q, "quantile_cont(value, 0.999)")
_FULL = f"""SELECT channel, {rnd('median')} AS median, {rnd('mean')} AS mean, {rnd('std')} AS std, {rnd('mad')} AS mad, {rnd('p01')} AS p01, {rnd('p99')} AS p99,
  {rnd('p99 / greatest(p01, 2.220446049250313e-16)')} AS dynamic_range, {rnd('dropout_frac')} AS dropout_frac, {rnd('saturation_frac')} AS saturation_frac FROM base JOIN more USING (channel)"""
ORACLE["channel_stats"] = f"WITH {_AUTO} {_FULL}"
ORACLE["channel_stats_int16"] = f"WITH {_STATS.format(Q, 'CAST(max(32767) AS DOUBLE)')} {_FULL}"
ORACLE["channel_mad"] = f"WITH {E}, med AS (SELECT channel, median(value) AS m FROM e GROUP BY channel) SELECT channel, {rnd('m')} AS median, {rnd('median(abs(value - m)) * 1.4826')} AS mad FROM e JOIN med USING (channel) GROUP BY channel, m"
ORACLE["temporal_profile"] = f"WITH {Q} SELECT t, {rnd('avg(value)')} AS value FROM q GROUP BY t"
ORACLE["persistence_score"] = f"WITH {_AUTO} SELECT channel, {rnd('persistence')} AS persistence FROM more"
ORACLE["channel_quality"] = f"""WITH {_AUTO} SELECT channel, {rnd('median')} AS noise_floor, {rnd('persistence')} AS persistence, {rnd('dropout_frac')} AS dropout_frac,
  {rnd('saturation_frac')} AS saturation_frac, dropout_frac <= 0 AND saturation_frac <= 0 AND persistence >= 0.9 AS good FROM base JOIN more USING (channel)"""
ORACLE["measure_noise"] = f"WITH {_AUTO} SELECT channel, {rnd('persistence * (1 - dropout_frac) * (1 - saturation_frac)')} AS noise FROM more"
ORACLE["select_persistent_channels"] = f"""WITH {_AUTO}, edge AS (SELECT quantile_cont(median, 0.1) AS a, quantile_cont(median, 0.9) AS b FROM base)
SELECT channel, {rnd('persistence')} AS persistence, median BETWEEN a AND b AND persistence >= 0.2 AND dropout_frac <= 0.2 AND saturation_frac <= 0.01 AS keep
FROM base JOIN more USING (channel), edge"""
ORACLE["channel_baseline"] = f"WITH {BASE} SELECT channel, {rnd('floor', 8)} AS floor, {rnd('scale', 8)} AS scale FROM base"

# transforms
ORACLE["normalize_zscore"] = f"WITH {E}, {ZS.format('e', 'channel')} SELECT t, channel, {rnd('z')} AS value FROM zs"
ORACLE["normalize_axis1"] = f"WITH {E}, {ZS.format('e', 't')} SELECT t, channel, {rnd('z')} AS value FROM zs"
ORACLE["normalize_robust"] = f"""WITH {E}, med AS (SELECT channel, median(value) AS m FROM e GROUP BY channel),
sc AS (SELECT channel, m, median(abs(value - m)) * 1.4826 AS s FROM e JOIN med USING (channel) GROUP BY channel, m)
SELECT t, channel, {rnd('(value - m) / (CASE WHEN s = 0 THEN 1 ELSE s END)')} AS value FROM e JOIN sc USING (channel)"""
ORACLE["normalize_minmax"] = f"""WITH {E}, mm AS (SELECT channel, min(value) AS a, max(value) - min(value) AS s FROM e GROUP BY channel)
SELECT t, channel, {rnd('(value - a) / (CASE WHEN s = 0 THEN 1 ELSE s END)')} AS value FROM e JOIN mm USING (channel)"""
ORACLE["detrend_linear"] = f"""WITH {E}, l AS (SELECT channel, covar_pop(value, t) / var_pop(t) AS b, avg(t) AS mt, avg(value) AS mv FROM e GROUP BY channel)
SELECT t, channel, {rnd('value - mv - b * (t - mt)')} AS value FROM e JOIN l USING (channel)"""
ORACLE["taper_tukey"] = f"""WITH {E}, n AS (SELECT max(t) + 1 AS n FROM e), w AS (SELECT t, channel, value, least(t, n - 1 - t) AS x, 0.1 * (n - 1) AS k FROM e, n)
SELECT t, channel, {rnd('value * CASE WHEN x >= k THEN 1 ELSE 0.5 * (1 - cos(pi() * x / k)) END')} AS value FROM w"""
ORACLE["smooth_temporal"] = f"WITH {E} SELECT t, channel, {rnd('avg(value) OVER (PARTITION BY channel ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)')} AS value FROM e"
ORACLE["smooth_spatial"] = f"WITH {E} SELECT t, channel, {rnd('avg(value) OVER (PARTITION BY t ORDER BY channel ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)')} AS value FROM e"
ORACLE["decimate_time"] = f"WITH {E} SELECT t // 7 AS t, channel, {rnd('avg(value)')} AS value FROM e WHERE t < (SELECT (max(t) + 1) // 7 * 7 FROM e) GROUP BY ALL"
ORACLE["decimate_channel"] = f"WITH {E} SELECT t, CAST(channel // 5 AS INTEGER) AS channel, {rnd('avg(value)')} AS value FROM e WHERE channel < (SELECT (max(channel) + 1) // 5 * 5 FROM e) GROUP BY ALL"
ORACLE["crop_image"] = f"WITH {E} SELECT t - 10 AS t, CAST(channel - 44 AS INTEGER) AS channel, {rnd('value')} AS value FROM e WHERE t >= 10 AND t < 60 AND channel >= 44 AND channel < 60"
ORACLE["time_shift_zero_fill"] = f"WITH {E} SELECT t, channel, {rnd('coalesce(lag(value, 13) OVER (PARTITION BY channel ORDER BY t), 0)')} AS value FROM e"

# correlation
ORACLE["pair_correlation"] = f"WITH {E} SELECT {rnd('corr(x.value, y.value)')} AS rho FROM e x JOIN e y USING (t) WHERE x.channel = 3 AND y.channel = 7"
ORACLE["correlation_matrix"] = f"WITH {E}, {ZS.format('e', 'channel')} SELECT x.channel AS i, y.channel AS j, {rnd('avg(x.z * y.z)')} AS rho FROM zs x JOIN zs y USING (t) GROUP BY ALL"
ORACLE["correlation_subset"] = f"WITH {E}, {ZS.format('e', 'channel')} SELECT x.channel AS i, y.channel AS j, {rnd('avg(x.z * y.z)')} AS rho FROM zs x JOIN zs y USING (t) WHERE x.channel IN (1, 5, 8, 40) AND y.channel IN (1, 5, 8, 40) GROUP BY ALL"
ORACLE["neighbor_correlation"] = f"WITH {E}, {ZS.format('e', 'channel')}, lags AS (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS lag) SELECT lag, {rnd('avg(x.z * y.z)')} AS rho FROM lags, zs x JOIN zs y USING (t) WHERE y.channel = x.channel + lag GROUP BY lag"


def _sliding(size: int, step: int) -> str:
    return f"""{E}, n AS (SELECT max(t) + 1 AS n FROM e), w AS (SELECT unnest(range(0, (n - {size}) // {step} + 1)) AS w FROM n),
i AS (SELECT w, t, channel, value FROM w JOIN e ON t >= w * {step} AND t < w * {step} + {size}),
zw AS (SELECT w, t, channel, (value - avg(value) OVER k) / (CASE WHEN stddev_pop(value) OVER k = 0 THEN 1 ELSE stddev_pop(value) OVER k END) AS z FROM i WINDOW k AS (PARTITION BY w, channel)),
r AS (SELECT x.w * {step} + {size // 2} AS center, avg(x.z * y.z) AS rho FROM zw x JOIN zw y ON x.w = y.w AND x.t = y.t AND y.channel = x.channel + 1 GROUP BY x.w)"""


ORACLE["sliding_neighbor_correlation"] = f"WITH {_sliding(40, 20)} SELECT center, {rnd('rho')} AS rho FROM r"
ORACLE["low_correlation_intervals"] = f"""WITH {_sliding(20, 10)}, g AS (SELECT *, row_number() OVER (ORDER BY center) AS n FROM r),
h AS (SELECT *, n - row_number() OVER (ORDER BY center) AS run FROM g WHERE rho <= 0)
SELECT min(center) AS "start", max(center) AS "end", count(*) AS length, {rnd('avg(rho)')} AS mean_corr FROM h GROUP BY run HAVING count(*) >= 2"""

# positions
ORACLE["positions_arrays"] = f"WITH {P} SELECT pos, channel_id, {rnd('lat', 9)} AS lat, {rnd('lon', 9)} AS lon FROM p"
ORACLE["local_xy"] = f"WITH {P} SELECT pos, {rnd(f'(lon - rlon) * {M} * cos(radians(rlat))', 4)} AS x, {rnd(f'(lat - rlat) * {M}', 4)} AS y FROM p, ref"
ORACLE["offset_m"] = f"WITH {A} SELECT ord, {rnd(f'(lat - CAST(55.32 AS DOUBLE)) * {M}', 4)} AS dlat_m, {rnd(f'(lon - CAST(11.02 AS DOUBLE)) * {M} * cos(radians(CAST(55.32 AS DOUBLE)))', 4)} AS dlon_m FROM a"
ORACLE["nearest_channel"] = f"WITH {P}, {A} SELECT ord, p.pos, {rnd(metres('a.lat', 'a.lon', 'p.lat', 'p.lon'), 4)} AS dist_m FROM a, p, ref QUALIFY row_number() OVER (PARTITION BY ord ORDER BY {metres('a.lat', 'a.lon', 'p.lat', 'p.lon')}, p.pos) = 1"
ORACLE["apply_translation"] = f"WITH {P} SELECT pos, {rnd(f'lat + CAST(136.7 AS DOUBLE) / {M}', 9)} AS lat, {rnd(f'lon + CAST(1232.9 AS DOUBLE) / ({M} * cos(radians(lat)))', 9)} AS lon FROM p"
ORACLE["geojson_linestring"] = f"WITH {P} SELECT 'cable' AS name, pos AS i, {rnd('lon', 9)} AS lon, {rnd('lat', 9)} AS lat FROM p"

# ship reports
ORACLE["ais_time_window"] = f"WITH {A} SELECT ord, mmsi AS MMSI FROM a WHERE ts >= TIMESTAMP '2024-01-05 07:59:00' AND ts < TIMESTAMP '2024-01-06 12:30:00'"
ORACLE["ais_dedupe_first"] = f"WITH {A} SELECT ord, mmsi AS MMSI FROM a QUALIFY row_number() OVER (PARTITION BY mmsi, date_trunc('hour', ts) ORDER BY ord) = 1"
ORACLE["ais_vessel_classes"] = f"WITH {A} SELECT ord, mmsi AS MMSI, kind FROM a WHERE kind IN ('click', 'view')"
ORACLE["ais_near_route"] = f"WITH {NEAR} SELECT ord, mmsi AS MMSI, channel_id AS NearestId, {rnd('d', 4)} AS DistToRoute_m FROM nr"
ORACLE["ais_transiting"] = f"WITH {NEAR} SELECT ord, mmsi AS MMSI FROM nr WHERE sog > 5"
ORACLE["ground_truth_crossings"] = f"WITH {CROSS} SELECT mmsi AS MMSI, epoch_us(ts) AS timestamp, pos AS channel, {rnd('lat')} AS Latitude, {rnd('lon')} AS Longitude, {rnd('d', 4)} AS DistToRoute_m FROM cr"
ORACLE["to_epoch_seconds"] = f"WITH {A} SELECT ord, {rnd('epoch_us(ts) / 1e6')} AS seconds FROM a"

# annotations
FILES = "f AS (SELECT event_id AS file, ts AS file_ts FROM events)"


def _at(files: str, source: str) -> str:
    return f"""att AS (SELECT f.file, s.mmsi, s.lat, s.lon FROM {files} f JOIN {source} s ON abs(epoch_us(s.ts) - epoch_us(f.center)) <= 3600000000
  QUALIFY row_number() OVER (PARTITION BY f.file, s.mmsi ORDER BY abs(epoch_us(s.ts) - epoch_us(f.center)), s.ord) = 1)"""


ORACLE["ship_positions_at"] = f"WITH {A}, {FILES}, c AS (SELECT file, file_ts AS center FROM f), {_at('c', 'a')} SELECT file, mmsi AS MMSI, {rnd('lat')} AS Latitude, {rnd('lon')} AS Longitude FROM att"
ORACLE["nearest_ship_distance"] = f"WITH {NEAR}, sr AS (SELECT avg(lat) AS slat, avg(lon) AS slon FROM nr) SELECT p.pos, {rnd('min(' + metres('p.lat', 'p.lon', 'nr.lat', 'nr.lon', 'slat', 'slon') + ')', 4)} AS distance_m FROM p, nr, sr GROUP BY p.pos"
ANN = f"""{NEAR}, {FILES}, c AS (SELECT file, file_ts + INTERVAL 5 SECOND AS center FROM f), {_at('c', 'nr')},
sr AS (SELECT file, avg(lat) AS slat, avg(lon) AS slon FROM att GROUP BY file),
dd AS (SELECT att.file, p.pos, round_even(min({metres('p.lat', 'p.lon', 'att.lat', 'att.lon', 'slat', 'slon')}) * 10, 0) / 10 AS d FROM att JOIN sr USING (file), p GROUP BY ALL),
ann AS (SELECT c.file, p.pos AS channel, coalesce(dd.d, 999999.0) AS distance_m, epoch_us(c.center) AS center_time FROM c CROSS JOIN p LEFT JOIN dd ON dd.file = c.file AND dd.pos = p.pos)"""
ORACLE["build_annotations"] = f"WITH {ANN} SELECT file, channel, {rnd('distance_m', 1)} AS distance_m, center_time FROM ann"
ORACLE["labels_for_range"] = f"WITH {ANN} SELECT file, channel, distance_m <= 1000 AS label FROM ann"
SCORES = """{0} AS accuracy, {1} AS precision, {2} AS recall, {3} AS f1"""


def _ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / {b} END)"


def _scores(right: str, total: str) -> str:
    precision, recall = _ratio("tp", "(tp + fp)"), _ratio("tp", "(tp + fn)")
    return SCORES.format(rnd(_ratio(right, total)), rnd(precision), rnd(recall), rnd(_ratio(f"(2 * {precision} * {recall})", f"({precision} + {recall})")))


ORACLE["benchmark_detections"] = f"""WITH {ANN}, fl AS (SELECT file, channel, distance_m, (file + channel) % 3 = 0 AS hit FROM ann),
rg AS (SELECT CAST(unnest([250, 500, 1000, 1500]) AS DOUBLE) AS range_m),
cm AS (SELECT range_m, count(*) FILTER (hit AND distance_m <= range_m) AS tp, count(*) FILTER (hit AND distance_m > range_m) AS fp,
  count(*) FILTER (NOT hit AND distance_m > range_m) AS tn, count(*) FILTER (NOT hit AND distance_m <= range_m) AS fn FROM rg, fl GROUP BY range_m)
SELECT range_m, tp, fp, tn, fn, {_scores('(tp + tn)', '(tp + tn + fp + fn)')} FROM cm"""
ORACLE["ship_present_files"] = f"WITH {ANN}, m AS (SELECT file, min(distance_m) AS d FROM ann GROUP BY file) SELECT count(*) FILTER (d < 1000) AS ship, count(*) FILTER (d >= 1000) AS quiet FROM m"

# evaluation
DET = f"""{CROSS}, n AS (SELECT count(*) AS n FROM p),
det AS (SELECT ord AS det_id, CAST(ord * 13 % n AS INTEGER) AS channel, ts FROM a, n),
nt AS (SELECT det.det_id, det.channel, cr.mmsi AS gt_id, cr.pos AS gt_channel, {metres('x.lat', 'x.lon', 'y.lat', 'y.lon')} AS dist, abs(epoch_us(det.ts) - epoch_us(cr.ts)) / 1e6 AS dt
  FROM det JOIN p x ON x.pos = det.channel, cr JOIN p y ON y.pos = cr.pos, ref
  QUALIFY row_number() OVER (PARTITION BY det.det_id ORDER BY dist, cr.mmsi) = 1),
mt AS (SELECT * FROM nt WHERE dist < 500 AND dt <= 86400 * 3 QUALIFY row_number() OVER (PARTITION BY gt_id ORDER BY dist, det_id) = 1)"""
ORACLE["match_detections_matched"] = f"WITH {DET} SELECT det_id, gt_id, channel, gt_channel, {rnd('dist', 4)} AS dist_m FROM mt"
ORACLE["match_detections_fp"] = f"WITH {DET} SELECT det_id, channel FROM det ANTI JOIN mt USING (det_id)"
ORACLE["match_detections_fn"] = f"WITH {DET} SELECT cr.mmsi AS gt_id, cr.pos AS channel FROM cr WHERE cr.mmsi NOT IN (SELECT gt_id FROM mt)"
ORACLE["compute_metrics"] = f"""WITH {DET}, cm AS (SELECT (SELECT count(*) FROM mt) AS tp, (SELECT count(*) FROM det) - (SELECT count(*) FROM mt) AS fp, (SELECT count(*) FROM cr) - (SELECT count(*) FROM mt) AS fn)
SELECT tp, fp, fn, {_scores('tp', '(tp + fp + fn)')} FROM cm"""
ORACLE["evaluate_at_ranges"] = f"""WITH {DET}, rg AS (SELECT CAST(unnest([5, 50, 250, 500]) AS DOUBLE) AS range_m),
b AS (SELECT gt_id, min(dist) AS d FROM nt WHERE dt <= 86400 * 3 GROUP BY gt_id),
h AS (SELECT range_m, count(*) FILTER (d < range_m) AS tp FROM rg, b GROUP BY range_m),
cm AS (SELECT range_m, tp, (SELECT count(*) FROM det) - tp AS fp, (SELECT count(*) FROM cr) - tp AS fn FROM h)
SELECT range_m, tp, fp, fn, {_scores('tp', '(tp + fp + fn)')} FROM cm"""


# offset
def _offsets(margins: str) -> str:
    return f"""{CROSS}, {Q}, bins AS (SELECT DISTINCT t, epoch_us(TIMESTAMP '2024-01-01 00:00:00') / 1e6 + t * 3600 AS bt FROM q),
cb AS (SELECT cr.mmsi, cr.lat, cr.lon, least(cr.pos, 63) AS near, bins.t FROM cr, bins QUALIFY row_number() OVER (PARTITION BY cr.mmsi ORDER BY abs(bt - epoch_us(cr.ts) / 1e6), bt) = 1),
mg AS (SELECT CAST(unnest({margins}) AS DOUBLE) AS margin_m),
lo AS (SELECT cb.mmsi, cb.lat, cb.lon, margin_m, q.channel, q.value FROM cb, mg, q WHERE q.t = cb.t
  AND q.channel >= near - round_even(margin_m / CAST(6.7 AS DOUBLE), 0) AND q.channel < near + round_even(margin_m / CAST(6.7 AS DOUBLE), 0)
  QUALIFY row_number() OVER (PARTITION BY cb.mmsi, margin_m ORDER BY q.value DESC, q.channel) = 1),
of1 AS (SELECT lo.mmsi, margin_m, lo.channel, (lo.lat - p.lat) * {M} AS dlat, (lo.lon - p.lon) * {M} * cos(radians(p.lat)) AS dlon FROM lo JOIN p ON p.pos = lo.channel),
md AS (SELECT margin_m, median(dlat) AS dlat, median(dlon) AS dlon FROM of1 GROUP BY margin_m)"""


_SWEEP = "[20, 40, 80, 160]"
_LENGTH = "sqrt(dlat * dlat + dlon * dlon)"
ORACLE["closest_approach_offset"] = f"WITH {_offsets('[80]')} SELECT mmsi AS cand_id, channel, {rnd('dlat', 4)} AS dlat_m, {rnd('dlon', 4)} AS dlon_m, {rnd(_LENGTH, 4)} AS dist_m FROM of1"
ORACLE["estimate_translation_offset"] = f"WITH {_offsets('[80]')} SELECT margin_m, {rnd('dlat', 4)} AS dlat_m, {rnd('dlon', 4)} AS dlon_m, {rnd(_LENGTH, 4)} AS dist_m FROM md"
ORACLE["margin_sensitivity"] = f"WITH {_offsets(_SWEEP)} SELECT margin_m, {rnd('dlat', 4)} AS dlat_m, {rnd('dlon', 4)} AS dlon_m, {rnd(_LENGTH, 4)} AS dist_m FROM md"
ORACLE["offset_winner"] = f"""WITH {_offsets(_SWEEP)}, lb(label, f) AS (VALUES ('a', CAST(1 AS DOUBLE)), ('b', CAST(1.5 AS DOUBLE)), ('c', CAST(2 AS DOUBLE))),
sw AS (SELECT label, margin_m, dlat * f AS dlat, dlon * f AS dlon, {_LENGTH} * f AS d FROM md, lb WHERE margin_m >= 80),
g AS (SELECT label, max(d) - min(d) AS spread, max(dlat) FILTER (margin_m = 160) AS dlat, max(dlon) FILTER (margin_m = 160) AS dlon, max(d) FILTER (margin_m = 160) AS d FROM sw GROUP BY label)
SELECT label, {rnd('spread', 4)} AS plateau_spread, {rnd('dlat', 4)} AS dlat_m, {rnd('dlon', 4)} AS dlon_m, {rnd('d', 4)} AS dist_m, d BETWEEN 500 AND 4000 AS in_range
FROM g ORDER BY in_range DESC, spread, label LIMIT 1"""

# detection
ORACLE["step_channels"] = f"WITH {E} SELECT DISTINCT channel FROM e WHERE channel % 10 = 0 OR channel = (SELECT max(channel) FROM e)"
ORACLE["fixed_threshold_dense"] = f"WITH {Q}, {ZS.format('q', 'channel')} SELECT t, channel, {rnd('z')} AS score, z > 4 AS triggered FROM zs"
ORACLE["fixed_threshold_sparse"] = f"WITH {Q}, {ZS.format('q', 'channel')} SELECT t, channel, {rnd('z')} AS score, true AS triggered FROM zs WHERE z > 4"
ORACLE["detect_subwindow_zscore"] = f"WITH {BASE} SELECT file, t, channel, {rnd('score', 5)} AS score, avg(CASE WHEN score > 6 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY file, channel) >= 0.1 AS triggered FROM z"
ORACLE["common_mode_suppression"] = f"""WITH {TRIG}, k AS (SELECT *, avg(CASE WHEN triggered THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY file, t) AS share FROM trig)
SELECT file, count(*) FILTER (triggered AND share <= 0.05) AS triggers, count(*) AS n FROM k GROUP BY file"""
ORACLE["spatial_corroboration"] = f"""WITH {TRIG}, on_ AS (SELECT * FROM trig WHERE triggered)
SELECT x.file, x.t, x.channel, x.triggered AND EXISTS (SELECT 1 FROM on_ y WHERE y.file = x.file AND abs(y.channel - x.channel) <= 3 AND abs(y.t - x.t) <= 2 AND (y.t <> x.t OR y.channel <> x.channel)) AS triggered FROM trig x"""
ORACLE["sta_lta_ratio"] = f"""WITH {Q} SELECT t, channel, {rnd('CASE WHEN count(value) OVER l > 0 THEN avg(value) OVER s / greatest(avg(value) OVER l, 1e-12) END')} AS ratio FROM q
WINDOW s AS (PARTITION BY channel ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), l AS (PARTITION BY channel ORDER BY t ROWS BETWEEN 43 PRECEDING AND 4 PRECEDING)"""
ORACLE["sta_lta_per_file"] = f"""WITH {Q}, r AS (SELECT t // 50 AS file, channel, CASE WHEN count(value) OVER l > 0 THEN avg(value) OVER s / greatest(avg(value) OVER l, 1e-12) END AS ratio FROM q
WINDOW s AS (PARTITION BY channel ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), l AS (PARTITION BY channel ORDER BY t ROWS BETWEEN 43 PRECEDING AND 4 PRECEDING))
SELECT file, channel, {rnd('max(ratio)')} AS score, avg(CASE WHEN ratio > 1.2 THEN 1.0 ELSE 0.0 END) >= 0.3 AS triggered FROM r GROUP BY ALL"""
STACK = f"""{Q}, pt AS (SELECT t // 50 AS file, t % 50 AS t, channel - 20 AS k, value FROM q WHERE channel BETWEEN 20 AND 34),
sl(si, s) AS (VALUES (0, CAST(-1.5 AS DOUBLE)), (1, CAST(-0.7 AS DOUBLE)), (2, CAST(0.5 AS DOUBLE)), (3, CAST(1.0 AS DOUBLE))),
st AS (SELECT file, si, CAST(t - round_even(k * s, 0) AS BIGINT) AS t0, avg(value) AS value FROM pt, sl GROUP BY ALL HAVING count(*) = 15 AND CAST(t0 AS BIGINT) BETWEEN 0 AND 49)"""
STACK = STACK.replace(" AND CAST(t0 AS BIGINT) BETWEEN 0 AND 49)", "), stk AS (SELECT * FROM st WHERE t0 BETWEEN 0 AND 49)")
ORACLE["radon_stack"] = f"WITH {STACK} SELECT file, si, t0, {rnd('value', 8)} AS value FROM stk"
ORACLE["radon_score"] = f"WITH {STACK} SELECT file, {rnd('value', 8)} AS score, si, t0 FROM stk QUALIFY row_number() OVER (PARTITION BY file ORDER BY value DESC, si, t0) = 1"
ORACLE["radon_detect"] = f"""WITH {STACK}, m AS (SELECT file, median(value) AS m, max(value) AS b FROM stk GROUP BY file),
d AS (SELECT file, m, b, median(abs(value - m)) * 1.4826 AS mad FROM stk JOIN m USING (file) GROUP BY ALL)
SELECT file, {rnd('(b - m) / greatest(mad, 1e-12)', 5)} AS ratio, {rnd('(b - m) / greatest(mad, 1e-12)', 5)} >= 3 AS triggered FROM d"""

# spectra
DFT = f"""{E}, ks AS (SELECT CAST(unnest(range(0, 33)) AS INTEGER) AS k),
sp AS (SELECT t AS vec_id, k, sum(value * cos(2.0 * pi() * k * channel / 64)) AS re, sum(value * sin(2.0 * pi() * k * channel / 64)) AS im FROM e, ks GROUP BY ALL),
pw AS (SELECT vec_id, k, re * re + im * im AS power FROM sp)"""
ORACLE["dft_power"] = f"WITH {DFT} SELECT vec_id, k, {rnd('power')} AS power FROM pw"
ORACLE["welch_psd"] = f"""WITH {E}, seg AS (SELECT vec_id, s, i, v FROM (SELECT e.t AS vec_id, s, e.channel - s AS i, value - avg(value) OVER (PARTITION BY e.t, s) AS v FROM e, (SELECT unnest([0, 16, 32]) AS s) WHERE e.channel >= s AND e.channel < s + 32)),
ks AS (SELECT CAST(unnest(range(0, 17)) AS INTEGER) AS k),
wv AS (SELECT vec_id, s, i, v * (0.5 - 0.5 * cos(2.0 * pi() * i / 32)) AS v FROM seg),
sp AS (SELECT vec_id, s, k, sum(v * cos(2.0 * pi() * k * i / 32)) AS re, sum(v * sin(2.0 * pi() * k * i / 32)) AS im FROM wv, ks GROUP BY ALL),
ww AS (SELECT sum(power(0.5 - 0.5 * cos(2.0 * pi() * i / 32), 2)) AS w FROM (SELECT unnest(range(0, 32)) AS i))
SELECT vec_id, k, {rnd('k * 2.0')} AS freq, {rnd('avg(re * re + im * im) / (64.0 * any_value(w)) * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END', 8)} AS power FROM sp, ww GROUP BY vec_id, k"""
ORACLE["dominant_frequency"] = f"WITH {DFT} SELECT vec_id, {rnd('CAST(k AS DOUBLE)')} AS freq FROM pw WHERE k BETWEEN 2 AND 30 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY power DESC, k) = 1"
BANDS = f"""{DFT}, ed AS (SELECT i AS band, [0, 1, 2, 5, 8, 13, 20, 30][i + 1] AS a, [0, 1, 2, 5, 8, 13, 20, 30][i + 2] AS b FROM (SELECT CAST(unnest(range(0, 7)) AS INTEGER) AS i)),
bp AS (SELECT vec_id, band, sum(CASE WHEN k >= a AND k < b THEN power ELSE 0 END) AS power FROM pw, ed GROUP BY ALL)"""
ORACLE["band_powers"] = f"WITH {BANDS} SELECT vec_id, band, {rnd('power')} AS power FROM bp"
_SHARE = "power / sum(power) OVER (PARTITION BY vec_id)"
ORACLE["band_powers_normalized"] = f"WITH {BANDS} SELECT vec_id, band, {rnd(_SHARE)} AS power FROM bp"
ORACLE["morlet_power"] = f"""WITH {E}, dm AS (SELECT t, channel, value - avg(value) OVER (PARTITION BY t) AS v FROM e), ks AS (SELECT unnest(range(1, 32)) AS k),
sp AS (SELECT t AS vec_id, k, sum(v * cos(2.0 * pi() * k * channel / 64)) AS re, sum(v * sin(2.0 * pi() * k * channel / 64)) AS im FROM dm, ks GROUP BY ALL),
fr(i, f) AS (VALUES (0, CAST(5 AS DOUBLE)), (1, CAST(12 AS DOUBLE)), (2, CAST(20 AS DOUBLE))), sc AS (SELECT i, (6 + sqrt(38.0)) / (4 * pi() * f) AS s FROM fr)
SELECT vec_id, i, {rnd('sum((re * re + im * im) * power(power(pi(), -0.25) * sqrt(2 * pi() * s * 64) * exp(-0.5 * power(s * 2 * pi() * k - 6, 2)), 2)) / 4096', 8)} AS power FROM sp, sc GROUP BY vec_id, i"""
ORACLE["morlet_scale"] = f"SELECT freq, {rnd('(6 + sqrt(38.0)) / (4 * pi() * freq)', 9)} AS scale FROM (SELECT unnest(range(1, 41)) AS freq)"
ORACLE["psd_median_iqr_by_label"] = f"WITH {DFT} SELECT label, CAST(k AS DOUBLE) AS freq, {rnd('quantile_cont(power, 0.25)')} AS p25, {rnd('median(power)')} AS median, {rnd('quantile_cont(power, 0.75)')} AS p75 FROM pw JOIN embeddings USING (vec_id) GROUP BY label, k"
ORACLE["psd_features"] = f"""WITH {BANDS}, dn AS (SELECT vec_id, CAST(k AS DOUBLE) AS f FROM pw WHERE k >= 1 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY power DESC, k) = 1),
tt AS (SELECT vec_id, sum(power) AS total FROM pw GROUP BY vec_id), sh AS (SELECT vec_id, band, {_SHARE} AS share FROM bp)
SELECT vec_id, {rnd('f')} AS dominant_freq_hz, {rnd('total')} AS total_power, band, {rnd('share')} AS share FROM sh JOIN dn USING (vec_id) JOIN tt USING (vec_id)"""
ORACLE["label_crosstab"] = f"""WITH {DFT}, dn AS (SELECT vec_id, k FROM pw WHERE k >= 1 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY power DESC, k) = 1)
SELECT label, CAST(k // 11 AS INTEGER) AS third, count(*) AS count FROM dn JOIN embeddings USING (vec_id) GROUP BY ALL"""

# selection
NOISE = f"{Q}, no AS (SELECT channel, avg(value) AS noise FROM q GROUP BY channel), tg AS (SELECT CAST(unnest(range(0, 64, 9)) AS INTEGER) AS target)"
ORACLE["context_window"] = f"WITH {NOISE} SELECT target, channel FROM tg, no WHERE abs(channel - target) <= 5 AND (noise >= 0.0155 OR channel = target)"
ORACLE["context_window_persistent"] = ORACLE["context_window"]

# augmentations
ORACLE["gain_by_table"] = f"WITH {E} SELECT t, channel, {rnd('value * (CAST(0.8 AS DOUBLE) + CAST(0.4 AS DOUBLE) * ((channel * 37) % 64) / 64)')} AS value FROM e"
ORACLE["mixup_by_table"] = f"WITH {E} SELECT x.t, x.channel, {rnd('((x.channel * 13) % 10) / CAST(10 AS DOUBLE) * x.value + (1 - ((x.channel * 13) % 10) / CAST(10 AS DOUBLE)) * y.value')} AS value FROM e x JOIN e y ON x.t = y.t AND y.channel = (x.channel * 29) % 64"
ORACLE["shuffle_by_table"] = f"WITH {E} SELECT x.t, x.channel, {rnd('y.value')} AS value FROM e x JOIN e y ON x.t = y.t AND y.channel = (x.channel * 27) % 64"

# samples, JSON and windows
O_ = "o AS (SELECT o_orderkey AS file, o_custkey % 25 AS dir, o_orderdate AS file_ts, o_custkey % 7 AS size FROM orders)"
ORACLE["modal_size_filter"] = f"WITH {O_}, m AS (SELECT size FROM o GROUP BY size ORDER BY count(*) DESC, size DESC LIMIT 1) SELECT file, size FROM o WHERE size = (SELECT size FROM m)"
ORACLE["stride_sample_per_dir"] = f"""WITH {O_}, n AS (SELECT dir, file, row_number() OVER (PARTITION BY dir ORDER BY file_ts, file) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY dir) // 20) AS s FROM o)
SELECT dir, file FROM n WHERE i % s = 0 AND i // s < 20"""
ORACLE["head_sample_per_dir"] = f"WITH {O_} SELECT dir, file FROM o QUALIFY row_number() OVER (PARTITION BY dir ORDER BY file_ts, file) <= 20"
ORACLE["props_from_json"] = "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"
ORACLE["annotations_json_round_trip"] = f"WITH {ANN} SELECT file, channel, {rnd('distance_m', 1)} AS distance_m FROM ann"
ORACLE["tumbling_count"] = f"SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS start, event_type, count(*) AS n, {rnd('avg(value)')} AS mean FROM events GROUP BY ALL"
ORACLE["session_islands"] = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 4 HOUR THEN 0 ELSE 1 END AS b FROM events),
i AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM i GROUP BY user_id, s"""

# exploration
FEAT = f"""{BANDS}, sh AS (SELECT vec_id, band AS k, {_SHARE} AS v FROM bp),
fz AS (SELECT vec_id, k, (v - avg(v) OVER w) / (CASE WHEN stddev_pop(v) OVER w = 0 THEN 1 ELSE stddev_pop(v) OVER w END) AS v FROM sh WINDOW w AS (PARTITION BY k)),
cl AS (SELECT vec_id, k, v, label % 2 AS c FROM fz JOIN embeddings USING (vec_id)),
ce AS (SELECT c, k, avg(v) AS m FROM cl GROUP BY ALL)"""
ORACLE["standard_features"] = f"WITH {FEAT} SELECT vec_id, k, {rnd('v', 5)} AS v FROM fz"
ORACLE["davies_bouldin"] = f"""WITH {FEAT}, ds AS (SELECT vec_id, c, sqrt(sum(power(v - m, 2))) AS d FROM cl JOIN ce USING (c, k) GROUP BY ALL), s AS (SELECT c, avg(d) AS s FROM ds GROUP BY c),
r AS (SELECT x.c, max((sx.s + sy.s) / y.d) AS r FROM (SELECT a.c, b.c AS o, sqrt(sum(power(a.m - b.m, 2))) AS d FROM ce a JOIN ce b ON a.k = b.k AND a.c <> b.c GROUP BY ALL) y JOIN (SELECT DISTINCT c FROM ce) x USING (c) JOIN s sx ON sx.c = y.c JOIN s sy ON sy.c = y.o GROUP BY x.c)
SELECT {rnd('avg(r)')} AS davies_bouldin FROM r"""
ORACLE["calinski_harabasz"] = f"""WITH {FEAT}, g AS (SELECT k, avg(v) AS gm FROM cl GROUP BY k),
t AS (SELECT sum(power(v - m, 2)) AS w, sum(power(m - gm, 2)) AS b, count(DISTINCT vec_id) AS n, count(DISTINCT c) AS kk FROM cl JOIN ce USING (c, k) JOIN g USING (k))
SELECT {rnd('b * (n - kk) / (w * (kk - 1))')} AS calinski_harabasz FROM t"""
ORACLE["silhouette"] = f"""WITH {FEAT}, pd AS (SELECT x.vec_id, x.c, y.vec_id AS o, y.c AS oc, sqrt(sum(power(x.v - y.v, 2))) AS d FROM cl x JOIN cl y ON x.k = y.k AND x.vec_id <> y.vec_id GROUP BY ALL),
mn AS (SELECT vec_id, c, oc, avg(d) AS d FROM pd GROUP BY ALL),
ab AS (SELECT vec_id, max(d) FILTER (c = oc) AS a, min(d) FILTER (c <> oc) AS b FROM mn GROUP BY vec_id)
SELECT {rnd('avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END)')} AS silhouette FROM ab"""
ORACLE["describe_energy"] = f"""WITH {Q} SELECT channel, count(*) AS count, {rnd('avg(value)')} AS mean, {rnd('stddev_samp(value)')} AS std, {rnd('min(value)')} AS min,
  {', '.join(f"{rnd(f'quantile_cont(value, {p / 100})')} AS p{p}" for p in (25, 50, 75))}, {rnd('max(value)')} AS max FROM q GROUP BY channel"""
#: The two largest principal axes by power iteration on the covariance, the first taken out for the second.
_POWER = """{0} AS (SELECT 0 AS i, list_transform(range(1, 8), lambda k: 1.0 / k) AS v
  UNION ALL SELECT i + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) FROM (SELECT i, list_transform(m, lambda r: list_dot_product(r, v)) AS w FROM {0}, {1} WHERE i < 600)),
{0}v AS (SELECT v FROM {0} WHERE i = 600)"""
ORACLE["feature_pca"] = f"""WITH RECURSIVE {FEAT}, cv AS (SELECT a.k AS i, b.k AS j, covar_samp(a.v, b.v) AS c FROM fz a JOIN fz b USING (vec_id) GROUP BY ALL),
m1 AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM cv GROUP BY i)),
{_POWER.format('p1', 'm1')},
ev AS (SELECT v, list_dot_product(list_transform(m, lambda r: list_dot_product(r, v)), v) AS l FROM p1v, m1),
m2 AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c - l * v[i + 1] * v[j + 1] ORDER BY j) AS r FROM cv, ev GROUP BY i)),
{_POWER.format('p2', 'm2')},
xs AS (SELECT vec_id, list(v ORDER BY k) AS x FROM fz GROUP BY vec_id)
SELECT vec_id, {rnd('abs(list_dot_product(x, p1v.v))', 5)} AS pc1, {rnd('abs(list_dot_product(x, p2v.v))', 5)} AS pc2 FROM xs, p1v, p2v"""
ORACLE["reports_csv"] = f"WITH {A} SELECT epoch_us(date_trunc('second', ts)) AS timestamp, kind, mmsi AS MMSI, {rnd('lat', 9)} AS Latitude, {rnd('lon', 9)} AS Longitude, {rnd('sog', 9)} AS SOG FROM a"
ORACLE["cable_json"] = f"WITH {P} SELECT pos, channel_id, {rnd('lat', 9)} AS lat, {rnd('lon', 9)} AS lon, CAST(-12.5 AS DOUBLE) AS depth, CAST(400 AS DOUBLE) AS fs FROM p"
ORACLE["results_csv"] = ORACLE["benchmark_detections"]
ORACLE["offset_json"] = f"WITH {_offsets('[80]')} SELECT {rnd('dlat', 4)} AS dlat_m, {rnd('dlon', 4)} AS dlon_m, 'band' AS label, {rnd(_LENGTH, 4)} AS dist_m, (SELECT count(*) FROM of1) AS n_candidates FROM md"
ORACLE["image_cache"] = f"WITH {E} SELECT t // 50 AS file, channel, {rnd(_REDUCE['rms'])} AS value, 1 AS computed FROM e GROUP BY ALL"
ORACLE["npy_files"] = f"WITH {E} SELECT epoch_us(TIMESTAMP '2024-01-01 00:00:00') + (t // 8) * 1000000 AS at, CAST(t % 8 AS INTEGER) AS channel, channel AS i, {rnd('value')} AS y FROM e WHERE t % 8 IN (0, 3, 7)"
