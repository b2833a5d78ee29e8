"""DuckDB SQL for filters, wavelets, detectors over waveforms, selection and augmentations.

Recursive filters and greedy walks are recursive queries, spectra are sums over sines. A filter's coefficients are
written into the SQL; tests/test_kernels.py holds their design against its formulas.
"""

from __future__ import annotations

import numpy as np

from ..functions.kernels import butterworth, steady_state
from ..operators import augment as au

FS = 64.0
E = """e AS (SELECT vec_id AS t, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS channel,
  CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"""
Q = E + """, q AS (SELECT t, channel, value * value AS value FROM e)"""
SIGNAL = f"{E}, sig AS (SELECT t AS id, channel AS i, value AS x FROM e)"
FILE = "'f' || lpad(CAST(id // 8 AS VARCHAR), 6, '0') AS file, CAST(id % 8 AS INTEGER) AS channel"
T0 = "epoch_us(TIMESTAMP '2024-01-01 00:00:00')"


def rnd(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + 0.0)"


def num(x: float) -> str:
    """A double's literal; without an exponent it would be a decimal."""
    return f"({x:.17e})"


def filtered(sos: np.ndarray, name: str = "y", source: str = "sig") -> str:
    """A table `name` (id, i, x) of the source's rows, filtered forth and back."""
    pad = 3 * (2 * len(sos) + 1 - min(int((sos[:, 2] == 0).sum()), int((sos[:, 5] == 0).sum())))
    states = [(f"s{k}", f"z{k}") for k in range(len(sos))]
    begin = ", ".join(f"{num(a)} * v[1] AS s{k}, {num(b)} * v[1] AS z{k}" for k, (a, b) in enumerate(steady_state(sos)))
    steps, last = [], "u"
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        steps.append(f"{num(b0)} * {last} + s{k} AS o{k}, {num(b1)} * {last} - {num(a1)} * o{k} + z{k} AS t{k}, {num(b2)} * {last} - {num(a2)} * o{k} AS r{k}")
        last = f"o{k}"
    after = ", ".join(f"t{k}, r{k}" for k in range(len(sos)))

    def walked(to: str, of: str) -> str:
        return f"""{to} AS (SELECT id, 0 AS j, CAST(NULL AS DOUBLE) AS y, {begin} FROM {of}
  UNION ALL SELECT id, j, {last}, {after} FROM (SELECT w.id, w.j + 1 AS j, {', '.join(x for s in states for x in s)}, d.v[w.j + 1] AS u, {', '.join(steps)} FROM {to} w JOIN {of} d ON d.id = w.id WHERE w.j < len(d.v)))"""

    return f"""{name}_l AS (SELECT id, list(x ORDER BY i) AS x, count(*) AS n FROM {source} GROUP BY id),
{name}_a AS (SELECT id, list_concat(list_concat(list_transform(range(0, {pad}), lambda k: 2 * x[1] - x[{pad} - k + 1]), x), list_transform(range(0, {pad}), lambda k: 2 * x[n] - x[n - 1 - k])) AS v FROM {name}_l),
{walked(name + '_f', name + '_a')},
{name}_b AS (SELECT id, list(y ORDER BY j DESC) AS v FROM {name}_f WHERE j > 0 GROUP BY id),
{walked(name + '_g', name + '_b')},
{name} AS (SELECT id, CAST(m - j AS INTEGER) - {pad} AS i, y AS x FROM (SELECT id, j, y, max(j) OVER (PARTITION BY id) AS m FROM {name}_g) WHERE j > {pad} AND j <= m - {pad})"""


def band(kind: str, edges, fs: float = FS) -> np.ndarray:
    return butterworth(4, edges, kind, fs)


BAND = f"{SIGNAL}, {filtered(band('bandpass', (4.0, 20.0)))}"
#: Wavelet power, sample by sample, of signals of 64 samples at 64 Hz: frequency k is bin k.
WAVE = f"""{SIGNAL}, dm AS (SELECT id, i, x - avg(x) OVER (PARTITION BY id) AS v FROM sig),
sp AS (SELECT id, k, sum(v * cos(2.0 * pi() * k * i / 64)) AS re, -sum(v * sin(2.0 * pi() * k * i / 64)) AS im FROM dm, (SELECT unnest(range(1, 32)) AS k) GROUP BY ALL),
sc AS (SELECT (6 + sqrt(38.0)) / (4 * pi() * 12.0) AS s),
sw AS (SELECT id, k, re * w AS re, im * w AS im FROM (SELECT id, k, re, im, power(pi(), -0.25) * sqrt(2 * pi() * s * 64) * exp(-0.5 * power(s * 2 * pi() * k - 6, 2)) AS w FROM sp, sc)),
y AS (SELECT id, i, power(sum(re * cos(2.0 * pi() * k * i / 64) - im * sin(2.0 * pi() * k * i / 64)) / 64, 2) + power(sum(re * sin(2.0 * pi() * k * i / 64) + im * cos(2.0 * pi() * k * i / 64)) / 64, 2) AS x
  FROM sw, (SELECT CAST(unnest(range(0, 64)) AS INTEGER) AS i) GROUP BY id, i)"""


def made() -> dict[str, str]:
    out: dict[str, str] = {}
    kinds = {"bandpass": ("bandpass", (4.0, 20.0)), "bandstop": ("bandstop", (4.0, 20.0)), "lowpass": ("lowpass", 10.0), "highpass": ("highpass", 10.0), "notch": ("bandstop", (13.5, 16.5))}
    for name, (kind, edges) in kinds.items():
        out[name] = f"WITH RECURSIVE {SIGNAL}, {filtered(band(kind, edges))} SELECT id AS vec_id, i, {rnd('x')} AS y FROM y"
    out["morlet_series"] = f"WITH {WAVE} SELECT id AS vec_id, i, {rnd('x')} AS y FROM y"
    out["bandpass_trimmed"] = f"WITH RECURSIVE {SIGNAL}, {filtered(band('bandpass', (1.0, 5.0), 16.0))} SELECT {FILE}, i - 16 AS i, {rnd('x')} AS y FROM y WHERE i BETWEEN 16 AND 47"
    single = "CAST(CAST({} AS FLOAT) AS DOUBLE)"
    out["bandpass_image"] = f"WITH RECURSIVE {BAND} SELECT {FILE}, {rnd(single.format('sqrt(avg(x * x))'))} AS value FROM y GROUP BY id"
    out["bandpass_energy_image"] = f"WITH RECURSIVE {BAND} SELECT {FILE}, {rnd('avg(x * x)')} AS value FROM y GROUP BY id"
    out["wavelet_image"] = f"WITH {WAVE} SELECT {FILE}, {rnd(single.format('avg(x)'))} AS value FROM y GROUP BY id"

    stepped = "id % 8 IN (0, 3, 6, 7)"
    out["detect_stream"] = f"""WITH RECURSIVE {BAND}, im AS (SELECT id, {single.format('sqrt(avg(x * x))')} AS v FROM y GROUP BY id),
md AS (SELECT id % 8 AS c, median(v) AS m FROM im GROUP BY ALL),
ba AS (SELECT c, m, greatest(median(abs(v - m)) * 1.4826, 1e-6 * greatest(m, 1)) AS s FROM im JOIN md ON id % 8 = c GROUP BY c, m),
sw AS (SELECT id, i // 16 AS w, sqrt(avg(x * x)) AS r FROM y WHERE {stepped} GROUP BY ALL),
zz AS (SELECT id, w, (r - m) / s AS z FROM sw JOIN ba ON id % 8 = c)
SELECT {FILE}, {rnd('(w + 0.5) * 0.25')} AS time_s, {rnd('z')} AS score, avg(CASE WHEN z > 1 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY id) >= 0.3 AS triggered,
  {T0} + (id // 8) * 1000000 + CAST((w + 0.5) * 250000 AS BIGINT) AS timestamp FROM zz"""

    def sta_lta(power: str) -> str:
        return f"""bn AS (SELECT id, i // 8 AS b, avg({power}) AS v FROM y WHERE {stepped} GROUP BY ALL),
ra AS (SELECT id, CASE WHEN count(v) OVER l > 0 THEN avg(v) OVER s / greatest(avg(v) OVER l, 1e-12) END AS r FROM bn
  WINDOW s AS (PARTITION BY id % 8 ORDER BY id // 8, b ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), l AS (PARTITION BY id % 8 ORDER BY id // 8, b ROWS BETWEEN 33 PRECEDING AND 2 PRECEDING))
SELECT {FILE}, 0.0 AS time_s, {rnd('max(r)')} AS score, avg(CASE WHEN r > 1.5 THEN 1.0 ELSE 0.0 END) >= 0.3 AS triggered FROM ra GROUP BY id"""

    out["sta_lta_stream"] = f"WITH RECURSIVE {BAND}, {sta_lta('x * x')}"
    out["sta_lta_stream_wavelet"] = f"WITH {WAVE}, {sta_lta('x')}"
    out["radon_detect_stream"] = f"""WITH RECURSIVE {BAND}, pw AS (SELECT id // 8 AS f, id % 8 AS c, i // 4 AS t, avg(x * x) AS v FROM y GROUP BY ALL),
ls AS (SELECT f, max(c) AS last FROM (SELECT 0 AS f, max(id % 8) AS c FROM y) GROUP BY f),
tg AS (SELECT tg, greatest(0, tg - 2) AS lo, least(last, tg + 2) AS hi FROM (SELECT unnest([0, 3, 6, 7]) AS tg), ls),
pt AS (SELECT f, tg, t, c - lo AS k, v FROM pw JOIN tg ON c BETWEEN lo AND hi WHERE hi - lo >= 2),
sl(si, s) AS (VALUES (0, CAST(-1 AS DOUBLE)), (1, CAST(-0.5 AS DOUBLE)), (2, CAST(0.5 AS DOUBLE)), (3, CAST(1 AS DOUBLE))),
sz AS (SELECT f, tg, max(t) + 1 AS nt, max(k) + 1 AS nk FROM pt GROUP BY ALL),
st AS (SELECT f, tg, si, CAST(t - round_even(k * s, 0) AS BIGINT) AS t0, avg(v) AS v, count(*) AS n FROM pt, sl GROUP BY ALL),
sk AS (SELECT st.* FROM st JOIN sz USING (f, tg) WHERE n = nk AND t0 >= 0 AND t0 < nt),
m AS (SELECT f, tg, median(v) AS m, max(v) AS b FROM sk GROUP BY ALL),
d AS (SELECT f, tg, (b - m) / greatest(median(abs(v - m)) * 1.4826, 1e-12) AS r FROM sk JOIN m USING (f, tg) GROUP BY f, tg, b, m)
SELECT 'f' || lpad(CAST(f AS VARCHAR), 6, '0') AS file, 0.0 AS time_s, CAST(tg AS INTEGER) AS channel, {rnd('r')} AS score, r >= 3 AS triggered FROM d"""
    return out | selection() | augmentations()


def walk(rows: str, alike: str) -> str:
    """kept (k, place): the rows (k from 1 on) that no row kept before is alike, in order; alike: (k, o) with o < k."""
    return f"""cf AS (SELECT r.k, list(a.o) FILTER (a.o IS NOT NULL) AS o FROM {rows} r LEFT JOIN {alike} a ON a.k = r.k GROUP BY r.k),
wk AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept
  UNION ALL SELECT cf.k, CASE WHEN coalesce(list_has_any(wk.kept, cf.o), false) THEN wk.kept ELSE list_append(wk.kept, cf.k) END FROM wk JOIN cf ON cf.k = wk.k + 1),
kp AS (SELECT unnest(kept) AS k, generate_subscripts(kept, 1) - 1 AS place FROM (SELECT kept FROM wk ORDER BY k DESC LIMIT 1))"""


def selection() -> dict[str, str]:
    rank = f"""{Q}, no AS (SELECT channel, avg(value) AS noise FROM q GROUP BY channel),
rk AS (SELECT row_number() OVER (ORDER BY noise DESC, channel) AS k, channel, noise FROM no),
zs AS (SELECT t, channel, (value - avg(value) OVER w) / (CASE WHEN stddev_pop(value) OVER w = 0 THEN 1 ELSE stddev_pop(value) OVER w END) AS z FROM e WINDOW w AS (PARTITION BY channel)),
co AS (SELECT x.channel AS i, y.channel AS j, avg(x.z * y.z) AS rho FROM zs x JOIN zs y USING (t) GROUP BY ALL)"""

    def greedy(max_corr: float, min_sep: int) -> str:
        return f"""{rank}, al AS (SELECT a.k, b.k AS o FROM rk a JOIN rk b ON b.k < a.k JOIN co ON co.i = a.channel AND co.j = b.channel WHERE abs(rho) > {max_corr} OR abs(a.channel - b.channel) < {min_sep}),
{walk('rk', 'al')}"""

    filled = f"""{greedy(0.15, 4)}, ch AS (SELECT channel FROM kp JOIN rk USING (k)),
gp AS (SELECT channel AS low, lead(channel) OVER (ORDER BY channel) AS high FROM ch),
pr AS (SELECT a.channel AS low, b.channel AS high FROM no a, no b WHERE b.channel - a.channel > 12),
bs AS (SELECT low, high, channel AS best FROM pr JOIN no ON channel BETWEEN low + 4 AND high - 4 QUALIFY row_number() OVER (PARTITION BY low, high ORDER BY noise DESC, abs(channel - (low + high) // 2), channel) = 1),
rc AS (SELECT low, high FROM gp WHERE high - low > 12
  UNION ALL SELECT CASE WHEN side = 0 THEN rc.low ELSE bs.best END, CASE WHEN side = 0 THEN bs.best ELSE rc.high END FROM rc JOIN bs ON bs.low = rc.low AND bs.high = rc.high, (VALUES (0), (1)) sd(side)),
fl AS (SELECT channel FROM ch UNION SELECT best FROM rc JOIN bs USING (low, high))"""
    trig = f"""{Q}, med AS (SELECT channel, median(value) AS m FROM q GROUP BY channel),
base AS (SELECT channel, m AS floor, greatest(median(abs(value - m)) * 1.4826, 1e-6 * greatest(m, 1)) AS scale FROM q JOIN med USING (channel) GROUP BY channel, m),
tr AS (SELECT t, channel, (value - floor) / scale AS score FROM q JOIN base USING (channel) WHERE (value - floor) / scale > 6),
rk AS (SELECT row_number() OVER (ORDER BY score DESC, t, channel) AS k, t, channel, score FROM tr),
nr AS (SELECT a.k, b.k AS o FROM rk a JOIN rk b ON abs(a.t - b.t) * 3 <= 5 AND abs(a.channel - b.channel) <= 10),
al AS (SELECT * FROM nr WHERE o < k)"""
    return {
        "greedy_decorrelated": f"WITH RECURSIVE {greedy(0.1, 2)} SELECT CAST(place AS INTEGER) AS place, channel FROM kp JOIN rk USING (k)",
        "target_select": f"WITH RECURSIVE {filled} SELECT channel FROM fl JOIN no USING (channel) ORDER BY noise DESC, channel LIMIT 10",
        "target_plan": f"WITH RECURSIVE {filled} SELECT fl.channel AS target, no.channel FROM fl JOIN no ON abs(no.channel - fl.channel) <= 4",
        "cluster_detections": f"""WITH RECURSIVE {trig}, {walk('rk', 'al')}, mb AS (SELECT nr.k, min(o) AS seed FROM nr JOIN kp ON kp.k = nr.o GROUP BY nr.k)
SELECT {T0} + t * 3000000 AS timestamp, channel, {rnd('score', 5)} AS score, n_members FROM rk JOIN (SELECT seed AS k, count(*) AS n_members FROM mb GROUP BY seed) USING (k)""",
    }


# augmentations: each gives a table (t, channel, value) from another one; tables are numbered


def draw(seed: int, *of: str) -> str:
    text = ", ".join([f"'{seed}'", *of])
    return f"(CAST('0x' || substr(md5(concat_ws('|', {text})), 1, {au.DRAW_DIGITS}) AS BIGINT) / {num(16**au.DRAW_DIGITS)})"


def normal(seed: int, *of: str) -> str:
    radius, angle = draw(seed, "'radius'", *of), draw(seed, "'angle'", *of)
    return f"(sqrt(-2 * ln(1 - {radius})) * cos(2 * pi() * {angle}))"


class Chain:
    """CTEs from a table r0 to r1, r2, ..; `sz` has the image's size (n, nc)."""

    def __init__(self):
        self.parts = [E, "r0 AS (SELECT * FROM e)", "sz AS (SELECT max(t) + 1 AS n, max(channel) + 1 AS nc, (max(t) + 1) // 2 + 1 AS m FROM e)"]
        self.n = 0

    def add(self, select: str, *ctes: str) -> Chain:
        """`select` reads the table {r}; names of ctes have the number as {i}."""
        self.n += 1
        self.parts += [c.format(r=f"r{self.n - 1}", i=self.n) for c in ctes]
        self.parts.append(f"r{self.n} AS ({select.format(r=f'r{self.n - 1}', i=self.n)})")
        return self

    def sql(self) -> str:
        return f"WITH {', '.join(self.parts)} SELECT t, channel, {rnd('value')} AS value FROM r{self.n}"

    def cells(self, value: str) -> Chain:
        return self.add(f"SELECT t, channel, {value} AS value FROM {{r}}, sz")

    def spectrum(self, change: str, *ctes: str) -> Chain:
        """`change` gives (channel, k, re, im) from f{i}."""
        forth = "f{i} AS (SELECT channel, k, sum(value * cos(2 * pi() * ((k * t) % n) / n)) AS re, -sum(value * sin(2 * pi() * ((k * t) % n) / n)) AS im FROM {r}, sz, (SELECT unnest(range(0, m)) AS k FROM sz) GROUP BY ALL)"
        weight = "CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END"
        back = f"SELECT t, channel, sum(({weight}) * (re * cos(2 * pi() * ((k * t) % n) / n) - im * sin(2 * pi() * ((k * t) % n) / n))) / any_value(n) AS value FROM g{{i}}, sz, (SELECT unnest(range(0, n)) AS t FROM sz) GROUP BY t, channel"
        return self.add(back, forth, *ctes, f"g{{i}} AS ({change})")

    def polar(self, magnitude: str, angle: str, source: str = "f{i}", *ctes: str) -> Chain:
        end = "k = 0 OR 2 * k = n"
        return self.spectrum(f"SELECT channel, k, CASE WHEN {end} THEN mag ELSE mag * cos(ang) END AS re, CASE WHEN {end} THEN 0 ELSE mag * sin(ang) END AS im FROM (SELECT channel, k, {magnitude} AS mag, {angle} AS ang FROM {source}, sz), sz", *ctes)


def bent(seed: int, place: str, count: str, most: str, a_point: int) -> str:
    """The place, moved by the random line."""
    points = f"greatest({count} // {a_point}, 4)"
    at = f"({place} * ({points} - 1.0) / ({count} - 1))"
    i = f"least(CAST(floor({at}) AS BIGINT), {points} - 2)"
    low, high = (f"((2 * {draw(seed, 'channel', x)} - 1) * {most})" for x in (i, f"{i} + 1"))
    return f"least(greatest({place} + {low} + ({at} - {i}) * ({high} - {low}), 0), {count} - 1)"


def spectral_mask(c: Chain, seed: int, n_bands: int = 1, max_width_hz: float = 5.0) -> Chain:
    width, first = f"({num(max_width_hz)} * {draw(seed, chr(39) + 'width' + chr(39), 'channel', 'b')})", f"({num(FS)} / n)"
    low = f"({first} + ((n // 2) * {num(FS)} / n - {width} - {first}) * {draw(seed, chr(39) + 'low' + chr(39), 'channel', 'b')})"
    bands = f"b{{i}} AS (SELECT channel, {low} AS low, {low} + {width} AS high FROM (SELECT DISTINCT channel FROM {{r}}), (SELECT unnest(range(0, {n_bands})) AS b), sz)"
    gone = f"EXISTS (SELECT 1 FROM b{{i}} b WHERE b.channel = f.channel AND f.k * {num(FS)} / n >= b.low AND f.k * {num(FS)} / n < b.high)"
    return c.spectrum(f"SELECT channel, k, CASE WHEN {gone} THEN 0 ELSE re END AS re, CASE WHEN {gone} THEN 0 ELSE im END AS im FROM f{{i}} f, sz", bands)


def frequency_shift(c: Chain, seed: int, max_shift_hz: float = 2.0) -> Chain:
    most = f"CAST(floor({num(max_shift_hz)} / {num(FS)} * n) AS BIGINT)"
    by = f"CAST(floor({draw(seed, 'channel')} * (2 * {most} + 1)) AS BIGINT) - {most}"
    return c.spectrum(f"SELECT channel, ((k + {by}) % m + m) % m AS k, re, im FROM f{{i}}, sz")


def phase_shift(c: Chain, seed: int) -> Chain:
    return c.polar("sqrt(re * re + im * im)", f"2 * pi() * {draw(seed, 'channel', 'k')}")


def frequency_jitter(c: Chain, seed: int, sigma_hz: float = 0.5) -> Chain:
    return c.polar(f"(sqrt(re * re + im * im) + 1e-12) * exp({num(sigma_hz)} * {normal(seed, 'channel', 'k')})", "atan2(im, re)")


def _read_at(i: str) -> str:
    """The value of a table p{i} (channel, k, at, ..) beside v{i} (channel, k, v), read at `at`."""
    return f"a.v + (p.at - floor(p.at)) * (coalesce(b.v, a.v) - a.v) AS v FROM p{i} p JOIN v{i} a ON a.channel = p.channel AND a.k = CAST(floor(p.at) AS BIGINT) LEFT JOIN v{i} b ON b.channel = p.channel AND b.k = CAST(floor(p.at) AS BIGINT) + 1"


def spectral_warp(c: Chain, seed: int, max_warp: float = 0.1) -> Chain:
    ctes = (
        "v{i} AS (SELECT channel, k, sqrt(re * re + im * im) AS v, atan2(im, re) AS angle FROM f{i})",
        f"p{{i}} AS (SELECT channel, k, angle, {bent(seed, 'k', 'm', f'({num(max_warp)} * m)', 8)} AS at FROM v{{i}}, sz)",
        f"w{{i}} AS (SELECT p.channel, p.k, p.angle, {_read_at('{i}')})",
    )
    return c.polar("v", "angle", "w{i}", *ctes)


def time_warp(c: Chain, seed: int, max_stretch: float = 0.1) -> Chain:
    ctes = (
        "v{i} AS (SELECT channel, t AS k, value AS v FROM {r})",
        f"p{{i}} AS (SELECT channel, t, {bent(seed, 't', 'n', f'({num(max_stretch)} * n)', 16)} AS at FROM {{r}}, sz)",
    )
    return c.add(f"SELECT t, channel, v AS value FROM (SELECT p.t, p.channel, {_read_at('{i}')})", *ctes)


def gain_randomization(c: Chain, seed: int) -> Chain:
    return c.cells(f"value * ({num(0.8)} + ({num(1.2)} - {num(0.8)}) * {draw(seed, 'channel')})")


def mixup(c: Chain, seed: int, alpha: float = 0.2) -> Chain:
    own = au.mixing_draws(64, alpha, seed)
    rows = ", ".join(f"({i}, {p}, {num(a)})" for i, (p, a) in enumerate(zip(own["partner"].tolist(), own["part"].tolist(), strict=True)))
    return c.add("SELECT x.t, x.channel, part * x.value + (1 - part) * y.value AS value FROM {r} x JOIN d{i} d ON d.channel = x.channel JOIN {r} y ON y.t = x.t AND y.channel = d.partner", f"d{{i}}(channel, partner, part) AS (VALUES {rows})")


def channel_shuffle(c: Chain, seed: int, max_swaps: int = 5) -> Chain:
    rows = ", ".join(f"({i}, {to})" for i, to in enumerate(au.swapped(64, max_swaps, seed).tolist()))
    return c.add("SELECT t, CAST(target AS INTEGER) AS channel, value FROM {r} x JOIN d{i} d ON d.channel = x.channel", f"d{{i}}(channel, target) AS (VALUES {rows})")


def augmentations() -> dict[str, str]:
    start = f"CAST(floor({num(au.drawn(5, 'start'))} * greatest(1, n - 50 + 1)) AS BIGINT)"
    single = {
        "add_noise": Chain().cells(f"value + {num(0.1)} * {normal(12, 'channel', 't')}"),
        "channel_dropout": Chain().cells(f"CASE WHEN {draw(2, 'channel')} < {num(0.2)} THEN 0.0 ELSE value END"),
        "time_mask": Chain().cells(f"CASE WHEN t >= {start} AND t < {start} + 50 THEN 0.0 ELSE value END"),
        "gain_randomization": gain_randomization(Chain(), 1),
        "mixup": mixup(Chain(), 3),
        "channel_shuffle": channel_shuffle(Chain(), 4),
        "spectral_mask": spectral_mask(Chain(), 6, 2),
        "frequency_shift": frequency_shift(Chain(), 7),
        "phase_shift": phase_shift(Chain(), 8),
        "spectral_warp": spectral_warp(Chain(), 9),
        "time_warp": time_warp(Chain(), 10),
        "frequency_jitter": frequency_jitter(Chain(), 11),
    }
    palette = (
        spectral_mask, frequency_shift, gain_randomization, lambda c, s: frequency_jitter(c, s, 0.3), mixup,
        lambda c, s: channel_shuffle(c, s, 3), lambda c, s: time_warp(c, s, 0.05),
    )
    chain = Chain()
    for i, seed in au.palette_draws(0.5, 13):
        chain = palette[i](chain, seed)
    return {name: c.sql() for name, c in (single | {"random_augment": chain}).items()}
