"""DuckDB equivalents of registered queries that rest on regressions with several terms.

A coefficient is that of the last column once all others have been swept out of it and of the outcome
(Frisch-Waugh); each sweep is one common table expression with window sums over all rows.
"""

from __future__ import annotations

from abacist.plans.models import LINE as MODEL_LINE
from abacist.plans.models import PANEL
from abacist.plans.registry import ORACLE_SQL


def swept(tag: str, sub: str, cols: list[str], target: str, keep: list[str] = []) -> str:
    """Common table expressions ending in ``tag`` (keep, r, e, b, n, k): the target's residual, the fit's residual, the coefficient.

    Empty columns are passed over; an empty target has no coefficient.
    """
    held, others = "".join(f"{c}, " for c in keep), [c for c in cols if c != target]
    one = lambda c: "1.0::DOUBLE AS one" if c == "one" else f"{c}::DOUBLE AS {c}"
    out = [f"{tag}_0 AS (SELECT {held}{', '.join(one(c) for c in ['y', *others, target])} FROM ({sub}))"]
    for i, c in enumerate(others):
        left = ["y", *others[i + 1 :], target]
        out.append(f"{tag}_{i + 1} AS (SELECT {held}{', '.join(f'{v} - CASE WHEN sum({c}*{c}) OVER () > 1e-9 THEN sum({v}*{c}) OVER () / sum({c}*{c}) OVER () * {c} ELSE 0 END AS {v}' for v in left)} FROM {tag}_{i})")
    out.append(f"{tag} AS (SELECT {held}{target} AS r, y - b*{target} AS e, b, n, {len(cols)} AS k FROM (SELECT *, CASE WHEN sum({target}*{target}) OVER () > 1e-9 THEN sum(y*{target}) OVER () / sum({target}*{target}) OVER () END AS b, count(*) OVER ()::DOUBLE AS n FROM {tag}_{len(others)}))")
    return ",\n".join(out)


PLAIN = "sqrt(sum(e*e) / (any_value(n) - any_value(k)) / sum(r*r))"


def hac(tag: str, order: str, lags: int) -> str:
    """A common table expression ``tag``_v (b, se) with Newey-West errors."""
    products = ", ".join(f"lag(r*e, {q}) OVER (ORDER BY {order}) AS l{q}" for q in range(1, lags + 1))
    meat = " + ".join(["sum(u*u)", *[f"{2 * (1 - q / (lags + 1))!r} * coalesce(sum(u*l{q}), 0)" for q in range(1, lags + 1)]])
    return f"{tag}_v AS (SELECT any_value(b) AS b, sqrt(({meat}) * any_value(n) / (any_value(n) - any_value(k))) / sum(r*r) AS se FROM (SELECT *, r*e AS u, {products} FROM {tag}))"


def normal_p(z: str) -> str:
    """Two-sided p-value: one less the error function, by its series of positive terms."""
    x = f"(abs({z})/sqrt(2))"
    terms = f"(SELECT sum(exp(i*ln(2.0) + (2*i + 1)*ln(greatest({x}, 1e-300)) - s)) FROM (SELECT i, sum(ln(2*i + 1)) OVER (ORDER BY i) AS s FROM range(0, 150) t(i)))"
    return f"CASE WHEN abs({z}) > 8 THEN 0.0 ELSE greatest(0.0, 1 - 2/sqrt(pi())*exp(-{x}*{x})*{terms}) END"


# ---------------------------------------------------------------- tests of a fit
ORACLE_SQL["white_test"] = f"""WITH {swept("f", f"SELECT y, a, b AS z, a AS a0, b AS z0 FROM ({MODEL_LINE})", ["one", "a", "z"], "z", ["a0", "z0"])},
{swept("g", "SELECT e*e AS y, a0 AS a, z0 AS z, a0*a0 AS aa, a0*z0 AS az, z0*z0 AS zz FROM f", ["one", "a", "z", "aa", "az", "zz"], "zz")},
t AS (SELECT any_value(n)*(1 - sum(e*e)/(SELECT var_pop(e*e)*count(*) FROM f)) AS lm FROM g) SELECT round(lm, 6) AS lm, round({normal_p("sqrt(lm)")} + sqrt(2*lm/pi())*exp(-lm/2)*(1 + lm/3), 6) AS p FROM t"""

ORACLE_SQL["reset_test"] = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS i, l_extendedprice AS y, l_quantity AS x FROM lineitem), {swept("f", "SELECT i, y, y AS y0, x, x AS x0 FROM d", ["one", "x"], "x", ["i", "y0", "x0"])},
z AS (SELECT y0 AS y, x0 AS x, (y0 - e - avg(y0 - e) OVER ()) / stddev_samp(y0 - e) OVER () AS z FROM f), {swept("g", "SELECT y, x, z*z AS z2, z*z*z AS z3 FROM z", ["one", "x", "z2", "z3"], "z3")},
t AS (SELECT ((SELECT sum(e*e) FROM f) - sum(e*e)) / 2 / (sum(e*e) / (any_value(n) - 4)) AS f, any_value(n) - 4 AS m FROM g) SELECT round(f, 6) AS f, round(power(1 + 2*f/m, -m/2), 6) AS p FROM t"""

_MONTHS = "SELECT date_trunc('month', l_shipdate) AS m, avg(l_extendedprice) AS y, avg(l_quantity) AS x FROM lineitem GROUP BY 1"
_TWO = f"SELECT y, lag(y) OVER w AS y1, lag(y, 2) OVER w AS y2, lag(x) OVER w AS x1, lag(x, 2) OVER w AS x2 FROM ({_MONTHS}) WINDOW w AS (ORDER BY m) QUALIFY y2 IS NOT NULL"
ORACLE_SQL["granger"] = f"""WITH s AS ({_TWO}), {swept("a", "SELECT * FROM s", ["one", "y1", "y2"], "y2")}, {swept("g", "SELECT * FROM s", ["one", "y1", "y2", "x1", "x2"], "x2")},
t AS (SELECT ((SELECT sum(e*e) FROM a) - sum(e*e)) / 2 / (sum(e*e) / (any_value(n) - 5)) AS f, any_value(n) - 5 AS m FROM g) SELECT round(f, 6) AS f, round(power(1 + 2*f/m, -m/2), 6) AS p FROM t"""

ORACLE_SQL["dickey_fuller"] = f"""WITH s AS (SELECT m, y - lag(y) OVER (ORDER BY m) AS y, lag(y) OVER (ORDER BY m) AS l FROM ({_MONTHS})), u AS (SELECT y, l, lag(y) OVER (ORDER BY m) AS d1 FROM s QUALIFY d1 IS NOT NULL),
{swept("g", "SELECT * FROM u", ["one", "d1", "l"], "l")} SELECT round(any_value(b) / {PLAIN}, 6) AS t FROM g"""


def _each(tag: str, sub: str, cols: list[str], names: dict[str, str], head: str) -> tuple[str, str]:
    """(common table expressions, selects) of every term of a regression."""
    parts = [swept(f"{tag}{i}", sub, cols, c) for i, c in enumerate(cols)]
    return ",\n".join(parts), " UNION ALL ".join(head.format(term=names.get(c, c), tag=f"{tag}{i}") for i, c in enumerate(cols))


_LAGGED = f"SELECT y, x, lag(y) OVER w AS l1, lag(x) OVER w AS l2 FROM ({_MONTHS}) WINDOW w AS (ORDER BY m) QUALIFY l1 IS NOT NULL"
_NAMES = {"one": "Intercept", "l1": "L1_l_extendedprice", "l2": "L1_l_quantity"}
_VAR = [_each(f"v{i}_", f"SELECT {c} AS y, l1, l2 FROM s", ["one", "l1", "l2"], _NAMES, f"SELECT '{e}' AS equation, '{{term}}' AS term, round(any_value(b), 6) AS estimate, round({PLAIN}, 6) AS std_error FROM {{tag}}") for i, (c, e) in enumerate((("y", "l_extendedprice"), ("x", "l_quantity")))]
ORACLE_SQL["vector_autoregression"] = f"WITH s AS ({_LAGGED}), {', '.join(a for a, _ in _VAR)} {' UNION ALL '.join(b for _, b in _VAR)}"

_ARMS = "SELECT l_extendedprice AS y, l_quantity AS x, l_discount AS z, (l_returnflag = 'R')::INT AS t, (l_linestatus = 'O')::INT AS s FROM lineitem"
_HEAD = "SELECT '{stage}' AS stage, '{{term}}' AS term, round(any_value(b), 6) AS estimate FROM {{tag}}"
_LATE = _each("q2_", "SELECT y, x, s, s*x AS sx FROM d", ["one", "x", "s", "sx"], {"one": "Intercept", "sx": "s:x"}, _HEAD.format(stage="second"))
_EARLY = _each("q1_", "SELECT y + greatest(g, 0) - s*g AS y, z, t, t*z AS tz FROM (SELECT *, (SELECT any_value(b) FROM q2_2) + (SELECT any_value(b) FROM q2_3)*x AS g FROM d)", ["one", "z", "t", "tz"], {"one": "Intercept", "tz": "t:z"}, _HEAD.format(stage="first"))
ORACLE_SQL["q_learning"] = f"WITH d AS MATERIALIZED ({_ARMS}), {_LATE[0]}, {_EARLY[0]} {_EARLY[1]} UNION ALL {_LATE[1]}"

ORACLE_SQL["oster"] = f"""WITH d AS (SELECT l_extendedprice AS y, (l_returnflag = 'R')::INT AS t, l_discount AS x, l_quantity AS q FROM lineitem), {swept("a", "SELECT y, t FROM d", ["one", "t"], "t")}, {swept("c", "SELECT * FROM d", ["one", "q", "x", "t"], "t")},
v AS (SELECT var_pop(y)*count(*) AS tss FROM d), k AS (SELECT (SELECT any_value(b) FROM a) b0, (SELECT any_value(b) FROM c) b1, 1 - (SELECT sum(e*e) FROM a)/tss r0, 1 - (SELECT sum(e*e) FROM c)/tss r1 FROM v),
z AS (SELECT *, (b0 - b1)*(least(1.0, 1.3*r1) - r1)/(r1 - r0) AS bias FROM k)
SELECT round(b0, 6) AS uncontrolled, round(b1, 6) AS controlled, round(r0, 6) AS r2_uncontrolled, round(r1, 6) AS r2_controlled, round(b1 - bias, 6) AS adjusted, round(b1/bias, 6) AS delta FROM z"""

# ---------------------------------------------------------------- series
_INDEX = "(year(l_shipdate) - 1995)*12 + month(l_shipdate) - 1"
_ITS = f"SELECT row_number() OVER (ORDER BY m) AS t, m, y FROM (SELECT {_INDEX} AS m, avg(l_extendedprice) AS y FROM lineitem GROUP BY 1)"
_TERMS = {"trend": "trend", "level": "level", "slope": "slope", "one": "Intercept"}
_PARTS = [(c, swept(f"i{k}", "SELECT * FROM u", ["one", "trend", "level", "slope"], c, ["t"]), hac(f"i{k}", "t", 4), f"i{k}") for k, c in enumerate(("one", "trend", "level", "slope"))]
ORACLE_SQL["its"] = f"""WITH s AS ({_ITS}), b AS (SELECT min(t) AS t0 FROM s WHERE m >= 40), u AS (SELECT t, y, t AS trend, (t >= t0)::INT AS level, (t >= t0)::INT*(t - t0) AS slope FROM s, b), {', '.join(f"{a}, {v}" for _, a, v, _ in _PARTS)}
{' UNION ALL '.join(f"SELECT '{_TERMS[c]}' AS term, round(b, 6) AS estimate, round(se, 6) AS std_error FROM {tag}_v" for c, _, _, tag in _PARTS)}"""

_SHOCK = f"SELECT m, y, s, lag(y) OVER w AS ly, lag(s) OVER w AS ls, {', '.join(f'lead(y, {h}) OVER w AS y{h}' for h in range(5))} FROM (SELECT {_INDEX} AS m, avg(l_extendedprice) AS y, avg(l_quantity) AS s FROM lineitem GROUP BY 1) WINDOW w AS (ORDER BY m)"
_STEPS = [(swept(f"h{h}", f"SELECT m, y{h} AS y, s, ly, ls FROM base WHERE y{h} IS NOT NULL AND ly IS NOT NULL", ["one", "ly", "ls", "s"], "s", ["m"]), hac(f"h{h}", "m", 6), h) for h in range(5)]
ORACLE_SQL["local_projection"] = f"""WITH base AS ({_SHOCK}), {', '.join(f"{a}, {v}" for a, v, _ in _STEPS)}, r AS ({' UNION ALL '.join(f"SELECT {h} AS horizon, b, se FROM h{h}_v" for _, _, h in _STEPS)})
SELECT horizon, round(b, 6) AS response, round(se, 6) AS std_error, round({normal_p("(b/se)")}, 6) AS p_value FROM r"""

# ---------------------------------------------------------------- panels
ORACLE_SQL["panel_random_effects"] = f"""WITH p AS ({PANEL}), c AS (SELECT i, y, x, avg(y) OVER w AS my, avg(x) OVER w AS mx, count(*) OVER w AS t FROM p WINDOW w AS (PARTITION BY i)),
f AS (SELECT *, sum((x-mx)*(y-my)) OVER () / sum((x-mx)*(x-mx)) OVER () AS b FROM c), u AS (SELECT i, any_value(my) AS y, any_value(mx) AS x, any_value(t) AS t FROM c GROUP BY i), {swept("g", "SELECT y, x FROM u", ["one", "x"], "x")},
v AS (SELECT sum(power(y - my - b*(x - mx), 2)) / (count(*) - count(DISTINCT i) - 1) AS se FROM f), h AS (SELECT se, greatest((SELECT sum(e*e)/(any_value(n) - 2) FROM g) - se/(SELECT count(*)/sum(1.0/t) FROM u), 0) AS su FROM v),
q AS (SELECT y - th*my AS y, x - th*mx AS x, 1 - th AS one_ FROM (SELECT *, 1 - sqrt(se/(se + t*su)) AS th FROM c, h)), {swept("z", "SELECT * FROM q", ["one_", "x"], "x")}
SELECT 'x' AS term, round(any_value(b), 6) AS estimate, round({PLAIN}, 6) AS std_error FROM z"""

_KS = [k for k in range(-4, 5) if k != -1]
_BOTH = lambda v: f"{v} - avg({v}) OVER (PARTITION BY i) - avg({v}) OVER (PARTITION BY t) + avg({v}) OVER () AS {v}"
_COLS = [f"e{k}".replace("-", "m") for k in _KS]
_EVENT = ", ".join(f"coalesce((e = {k})::INT, 0)::DOUBLE AS {c}" for k, c in zip(_KS, _COLS))
ORACLE_SQL["did_event_study"] = f"""WITH p AS (SELECT i, t, y, least(greatest(t - g, -4), 4) AS e FROM ({PANEL})), w AS (SELECT i, t, y, {_EVENT} FROM p), d AS MATERIALIZED (SELECT i, {', '.join(_BOTH(v) for v in ['y', *_COLS])} FROM w),
{', '.join(swept(f"k{n}_", "SELECT * FROM d", _COLS, c, ["i"]) for n, c in enumerate(_COLS))}, l AS (SELECT count(DISTINCT t) AS lt, count(DISTINCT e) FILTER (e <> -1) AS ke FROM p)
{' UNION ALL '.join(f"SELECT 'e{k}' AS term, round(any_value(b), 6) AS estimate, round(sqrt(sum(s*s) * count(*)/(count(*) - 1.0) * (any_value(n) - 1)/(any_value(n) - any_value(ke) - any_value(lt))) / sum(rr), 6) AS std_error FROM (SELECT i, sum(r*e) AS s, sum(r*r) AS rr, any_value(b) AS b, any_value(n) AS n FROM k{n}_ GROUP BY i), l HAVING any_value(b) IS NOT NULL" for n, k in enumerate(_KS))}"""

# ---------------------------------------------------------------- others
ORACLE_SQL["sequential_test"] = """WITH b AS (SELECT year(l_shipdate) AS m, sum(l_discount) AS s, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1), v AS (SELECT m, sum(n) OVER w AS n, sum(s) OVER w / sum(n) OVER w AS mean FROM b WINDOW w AS (ORDER BY m)),
l AS (SELECT *, 0.5*ln(0.01/(0.01 + n)) + n*n*mean*mean/(2*0.01*(0.01 + n)) AS lr FROM v) SELECT m, n::BIGINT AS n, round(mean, 6) AS mean, round(min(least(1.0, exp(-least(lr, 700)))) OVER (ORDER BY m), 6) AS p_value FROM l"""

ORACLE_SQL["kdensity"] = """WITH s AS (SELECT count(*)::DOUBLE n, stddev_samp(o_totalprice) sd, min(o_totalprice) lo, max(o_totalprice) hi, quantile_cont(o_totalprice, 0.25) a, quantile_cont(o_totalprice, 0.75) b FROM orders),
p AS (SELECT *, 0.9*least(sd, (b - a)/1.349)*power(n, -0.2) AS h, (hi - lo)/4096 AS step FROM s), c AS (SELECT least(floor((o_totalprice - lo)/step), 4095) AS cell, count(*)::DOUBLE AS k, avg(o_totalprice) AS m FROM orders, p GROUP BY 1),
g AS (SELECT lo - 3*h + i*((hi - lo + 6*h)/63) AS x, h, n FROM p, range(0, 64) t(i)) SELECT round(x, 6) AS x, round(sum(k*exp(-power((x - m)/h, 2)/2))/(any_value(n)*any_value(h)*sqrt(2*pi())), 6) AS density FROM g, c GROUP BY x"""
