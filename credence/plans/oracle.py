"""Pieces of DuckDB SQL that say the same as the library's expressions."""

from __future__ import annotations

from ..functions import special as S


def horner(coefficients, x: str) -> str:
    out = repr(float(coefficients[0])) + "::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {float(c)!r}::DOUBLE)"
    return out


def phi_inv(p: str) -> str:
    low, q = S.ACKLAM_LOW, f"({p} - 0.5::DOUBLE)"
    tail = lambda v: f"({horner(S.ACKLAM_C, v)} / {horner((*S.ACKLAM_D, 1.0), v)})"
    left, right = f"sqrt(-2.0::DOUBLE * ln({p}))", f"sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {p}))"
    mid = f"({horner(S.ACKLAM_A, f'({q} * {q})')} * {q} / {horner((*S.ACKLAM_B, 1.0), f'({q} * {q})')})"
    return f"(CASE WHEN {p} < {low}::DOUBLE THEN {tail(left)} WHEN {p} <= {1 - low!r}::DOUBLE THEN {mid} ELSE -{tail(right)} END)"


def ln_gamma(x: str) -> str:
    series = f"{S.LANCZOS_BASE!r}::DOUBLE" + "".join(f" + ({c!r}::DOUBLE) / ({x} + {1.0 + i!r}::DOUBLE)" for i, c in enumerate(S.LANCZOS))
    return f"(ln(2.5066282746310002::DOUBLE * ({series}) / ({x})) - (({x} + 5.5::DOUBLE) - ({x} + 0.5::DOUBLE) * ln({x} + 5.5::DOUBLE)))"


def uniform(seed: int, *keys: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"({k})::VARCHAR" for k in keys]])
    return f"(((('0x' || substr(md5({text}), 1, 13))::BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def softplus(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN {x} + ln(1.0::DOUBLE + exp(-({x}))) ELSE ln(1.0::DOUBLE + exp({x})) END)"


SERIES = """days AS (
  SELECT l_returnflag AS series_id, l_shipdate::DATE AS day, sum(l_extendedprice * (1 - l_discount)) / 100000.0::DOUBLE AS y FROM lineitem GROUP BY ALL
), spans AS (
  SELECT series_id, min(day) AS f, max(day) AS e FROM days GROUP BY ALL
), grid AS (
  SELECT series_id, f, unnest(generate_series(f::TIMESTAMP, e::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM spans
), series AS (
  SELECT g.series_id, date_diff('day', g.f, g.day)::INTEGER AS t, d.y FROM grid g LEFT JOIN days d ON g.series_id = d.series_id AND g.day = d.day
)"""

DRAWS = """raw AS (
  SELECT event_type AS param, (event_id % 4)::INTEGER AS chain, (row_number() OVER (PARTITION BY event_type, event_id % 4 ORDER BY event_id) - 1)::INTEGER AS draw, value FROM events
), sizes AS (
  SELECT param, min(n) AS n FROM (SELECT param, chain, count(*) AS n FROM raw GROUP BY ALL) GROUP BY ALL
), draws AS (
  SELECT param, chain, draw, value FROM raw JOIN sizes USING (param) WHERE draw < n
)"""

SPLIT = """cnt AS (
  SELECT *, count(*) OVER (PARTITION BY param, chain) // 2 AS n, count(*) OVER (PARTITION BY param, chain) AS len FROM {draws}
), split AS (
  SELECT param, (chain * 2 + CASE WHEN draw >= len - n THEN 1 ELSE 0 END) AS half, draw - CASE WHEN draw >= len - n THEN len - n ELSE 0 END AS t, n, value FROM cnt WHERE draw < n OR draw >= len - n
)"""


def ranked(source: str, keep: str) -> str:
    """``source`` with values replaced by normal scores of their ranks."""
    p = "(rk + (ties - 1) / 2.0::DOUBLE - 0.375::DOUBLE) / (total + 0.25::DOUBLE)"
    return f"""(SELECT {keep}, {phi_inv('pr')} AS value FROM (SELECT *, {p} AS pr FROM (
  SELECT *, rank() OVER (PARTITION BY param ORDER BY value) AS rk, count(*) OVER (PARTITION BY param, value) AS ties, count(*) OVER (PARTITION BY param) AS total FROM {source})))"""


def r_hat(source: str) -> str:
    return f"""(SELECT param, sqrt(((n - 1.0::DOUBLE) / n * w + b / n) / w) AS r FROM (
  SELECT param, avg(v) AS w, any_value(k) * var_samp(m) AS b, any_value(k) AS n FROM (SELECT param, half, avg(value) AS m, var_samp(value) AS v, count(*) AS k FROM {source} GROUP BY ALL) GROUP BY param))"""


def ess(source: str) -> str:
    """ESS of the split chains of ``source`` (param, chain, draw, value)."""
    return f"""(WITH {SPLIT.format(draws=source)}, c AS (
  SELECT *, value - avg(value) OVER (PARTITION BY param, half) AS d FROM split
), st AS (
  SELECT param, avg(v) AS w, var_samp(m) AS bn, any_value(k) AS n, count(*) AS m FROM (SELECT param, half, avg(value) AS m, var_samp(value) AS v, count(*) AS k FROM split GROUP BY ALL) GROUP BY param
), g AS (
  SELECT a.param, b.t - a.t AS lag, sum(a.d * b.d) AS g FROM c a JOIN c b ON a.param = b.param AND a.half = b.half AND b.t >= a.t GROUP BY ALL
), r AS (
  SELECT g.param, lag // 2 AS pair, CASE WHEN lag = 0 THEN 1.0::DOUBLE ELSE 1 - (w - g / (m * n)) / ((n - 1.0::DOUBLE) / n * w + bn) END AS rho FROM g JOIN st USING (param)
), p AS (
  SELECT param, pair, sum(rho) AS p FROM r GROUP BY ALL HAVING count(*) = 2
), q AS (
  SELECT *, max(CASE WHEN p < 0 THEN 1 ELSE 0 END) OVER o AS ended, min(p) OVER o AS low FROM p WINDOW o AS (PARTITION BY param ORDER BY pair ROWS UNBOUNDED PRECEDING)
), s AS (
  SELECT param, sum(low) AS s FROM q WHERE ended = 0 GROUP BY param
)
SELECT st.param, m * n / greatest(-1 + 2 * coalesce(s, 0), 1 / log10(m * n)) AS ess FROM st LEFT JOIN s USING (param))"""


def kalman(q: float, r: float, m0: float, p0: float, a: float = 1.0) -> str:
    """Filter of a scalar system over ``series``: k(series_id, t, pm, pp, m, p, ll)."""
    pp = f"({a * a!r}::DOUBLE * k.p + {q!r}::DOUBLE)"
    pm = f"({a!r}::DOUBLE * k.m)"
    gain = f"({pp} / ({pp} + {r!r}::DOUBLE))"
    return f"""k AS (
  SELECT series_id, -1 AS t, 0.0::DOUBLE AS pm, 0.0::DOUBLE AS pp, {m0!r}::DOUBLE AS m, {p0!r}::DOUBLE AS p, 0.0::DOUBLE AS ll FROM spans
  UNION ALL
  SELECT k.series_id, s.t, {pm}, {pp},
    CASE WHEN s.y IS NULL THEN {pm} ELSE {pm} + {gain} * (s.y - {pm}) END,
    CASE WHEN s.y IS NULL THEN {pp} ELSE (1 - {gain}) * (1 - {gain}) * {pp} + {gain} * {gain} * {r!r}::DOUBLE END,
    CASE WHEN s.y IS NULL THEN 0.0::DOUBLE ELSE -0.5::DOUBLE * (1.8378770664093453::DOUBLE + ln({pp} + {r!r}::DOUBLE) + (s.y - {pm}) * (s.y - {pm}) / ({pp} + {r!r}::DOUBLE)) END
  FROM k JOIN series s ON s.series_id = k.series_id AND s.t = k.t + 1
)"""
