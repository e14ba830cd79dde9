"""DuckDB SQL of the regression: Newton steps over the design's cells, clustered covariance, intervals, tails."""

from __future__ import annotations

from spindrift.operators import logit
from spindrift.plans.sql import BASE

K = range(1, 7)
#: Fixed value: the 97.5 % quantile of the normal distribution.
Z = 1.959963984540054
_X = {1: "1.0", 2: "model_correct::INT", 3: "user_present::INT", 4: "doc_present::INT", 5: "(user_present AND user_correct)::INT", 6: "(doc_present AND doc_correct)::INT"}
_DOT = " + ".join(f"b[{i}] * e.x[{i}]" for i in K)
_ROW = f"[{', '.join(f'({x})::DOUBLE' for x in _X.values())}]"
_H = [(i, j) for i in K for j in range(1, i + 1)]


def _cholesky() -> str:
    """Columns ``l`` of the factor of ``h``, each from those before."""
    out = []
    for j in K:
        for i in range(j, 7):
            rest = "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j))
            out.append(f"sqrt(h{j}{j}{rest}) AS l{j}{j}" if i == j else f"(h{i}{j}{rest}) / l{j}{j} AS l{i}{j}")
    return ", ".join(out)


def _solved(right: dict[int, str], name: str) -> str:
    """Columns ``name`` 1 to 6 that solve h * name = right."""
    down = [f"({right[i]}{''.join(f' - l{i}{k} * {name}y{k}' for k in range(1, i))}) / l{i}{i} AS {name}y{i}" for i in K]
    up = [f"({name}y{i}{''.join(f' - l{k}{i} * {name}{k}' for k in range(i + 1, 7))}) / l{i}{i} AS {name}{i}" for i in reversed(K)]
    return ", ".join(down + up)


_PARTS = f"list_transform(c, lambda e: struct_pack(x := e.x, n := e.n, s := e.s, p := 1 / (1 + exp(-({_DOT}))))) AS q"
_SUMS_H = ", ".join(f"list_sum(list_transform(q, lambda e: e.n * e.p * (1 - e.p) * e.x[{i}] * e.x[{j}])) AS h{i}{j}" for i, j in _H)
_SUMS_G = ", ".join(f"list_sum(list_transform(q, lambda e: (e.s - e.n * e.p) * e.x[{i}])) AS g{i}" for i in K)
_M = {(i, j): f"m{max(i, j)}{min(i, j)}" for i in K for j in K}
_COV = [(i, i) for i in K] + [(3, 5), (4, 6)]

FIT = BASE.replace("WITH ex", "WITH RECURSIVE ex", 1) + f""",
cell AS (SELECT experiment, {_ROW} AS x, count(*) AS n, count(*) FILTER (output_correct) AS s FROM m GROUP BY experiment, {_ROW}),
cells AS (SELECT experiment, list(struct_pack(x := x, n := n::DOUBLE, s := s::DOUBLE)) AS c, sum(n)::DOUBLE AS n, sum(s)::DOUBLE AS s FROM cell GROUP BY experiment),
nt(experiment, c, it, b) AS (SELECT experiment, c, 0, [0.0::DOUBLE, 0.0, 0.0, 0.0, 0.0, 0.0] FROM cells UNION ALL
  SELECT experiment, c, it + 1, [{', '.join(f'b[{i}] + d{i}' for i in K)}] FROM (SELECT *, {_solved({i: f'g{i}' for i in K}, 'd')} FROM (SELECT *, {_cholesky()} FROM (SELECT *, {_SUMS_H}, {_SUMS_G} FROM (SELECT *, {_PARTS} FROM nt WHERE it < 20) a) b_) c_) d_),
inv AS (SELECT experiment, b, q, {', '.join(_solved({i: '1.0' if i == j else '0.0' for i in K}, f'v{j}') for j in K)} FROM (SELECT *, {_cholesky()} FROM (SELECT *, {_SUMS_H} FROM (SELECT *, {_PARTS} FROM nt WHERE it = 20) a) b_) c_),
obs AS (SELECT m.experiment, qid, {_ROW} AS x, output_correct::INT AS y, b FROM m JOIN inv USING (experiment)),
res AS (SELECT *, y - 1 / (1 + exp(-({_DOT.replace('e.x', 'x')}))) AS r FROM obs),
sc AS (SELECT experiment, qid, {', '.join(f'sum(r * x[{i}]) AS s{i}' for i in K)} FROM res GROUP BY experiment, qid),
meat AS (SELECT experiment, count(*)::DOUBLE AS g, {', '.join(f'sum(s{i} * s{j}) AS m{i}{j}' for i, j in _H)} FROM sc GROUP BY experiment),
bm AS (SELECT inv.*, g, cells.n, cells.s, {', '.join(f'{" + ".join(f"v{k}{i} * {_M[k, j]}" for k in K)} AS t{i}{j}' for i in K for j in K)} FROM inv JOIN meat USING (experiment) JOIN cells USING (experiment)),
fit AS (SELECT experiment, b, q, g, n, s, {', '.join(f'g / (g - 1) * (n - 1) / (n - 6) * ({" + ".join(f"t{i}{k} * v{j}{k}" for k in K)}) AS c{i}{j}' for i, j in _COV)} FROM bm)
"""


def tail(x: str) -> str:
    """erfc of a non-negative expression by the series of positive terms; beyond 6 it is 0 to 16 decimals."""
    series = f"list_reduce(list_concat([[1.0::DOUBLE, 1.0]], list_transform(range(1, 250), lambda i: [i::DOUBLE, 0.0])), lambda u, e: [u[1] + u[2] * 2 * ({x}) ** 2 / (2 * e[1] + 1), u[2] * 2 * ({x}) ** 2 / (2 * e[1] + 1)])[1]"
    return f"CASE WHEN ({x}) > 6 THEN 0.0 ELSE greatest(0.0, 1 - 1.1283791670955126 * exp(-(({x}) ** 2)) * ({x}) * {series}) END"


_TERM = FIT + ", term AS (" + " UNION ALL ".join(f"SELECT experiment, '{t}' AS term, b[{i}] AS estimate, sqrt(c{i}{i}) AS se FROM fit" for i, t in enumerate(logit.TERMS, 1)) + "), tz AS (SELECT *, estimate / se AS z, abs(estimate / se) / sqrt(2.0) AS a FROM term)"
_ROUND = lambda x, name, n=6: f"round({x}, {n}) AS {name}"
COEFFICIENTS = _TERM + "SELECT experiment, term, " + ", ".join(_ROUND(x, n) for x, n in (
    ("estimate", "estimate"), ("se", "se"), ("z", "z"), (tail("a"), "p"), (f"estimate - {Z} * se", "low"), (f"estimate + {Z} * se", "high"),
    ("exp(estimate)", "odds"), (f"exp(estimate - {Z} * se)", "odds_low"), (f"exp(estimate + {Z} * se)", "odds_high"))) + " FROM tz"

_RATIOS = [(f"{s}_{what}", i, j, sign) for s, i, j in (("user", 3, 5), ("doc", 4, 6)) for what, sign in (("composite", 1), ("selectivity", -1))]
_RATIO = FIT + ", ratio AS (" + " UNION ALL ".join(f"SELECT experiment, '{name}' AS ratio, {sign} * b[{i}] + b[{j}] AS v, sqrt(c{i}{i} + c{j}{j} + {2 * sign} * c{i}{j}) AS se FROM fit" for name, i, j, sign in _RATIOS) + ")"
ODDS = _RATIO + f"SELECT experiment, ratio, {_ROUND('exp(v)', 'value')}, {_ROUND(f'exp(v - {Z} * se)', 'low')}, {_ROUND(f'exp(v + {Z} * se)', 'high')} FROM ratio"

STATISTICS = FIT + f""", lf AS (SELECT *, list_sum(list_transform(q, lambda e: e.s * ln(e.p) + (e.n - e.s) * ln(1 - e.p))) AS llf, s * ln(s / n) + (n - s) * ln(1 - s / n) AS llnull FROM fit),
lx AS (SELECT *, 2 * (llf - llnull) AS x, sqrt(llf - llnull) AS a FROM lf)
SELECT experiment, true AS converged, n::BIGINT AS n, g::BIGINT AS clusters, 5 AS df, {_ROUND('1 - llf / llnull', 'pseudo_r2')}, {_ROUND('llf', 'llf')}, {_ROUND('llnull', 'llnull')},
{_ROUND(f'{tail("a")} + sqrt(2 * x / pi()) * exp(-x / 2) * (1 + x / 3)', 'llr_p')}, {_ROUND('12 - 2 * llf', 'aic')}, {_ROUND('6 * ln(n) - 2 * llf', 'bic')} FROM lx"""

_NAMES = list(logit.ODDS_NAMES.values())
ODDS_TABLE = _RATIO + ", t AS (" + " UNION ALL ".join(f"SELECT experiment, '{name}' AS name, round(exp(b[{i}]), 3) AS ratio, NULL::DOUBLE AS low, NULL::DOUBLE AS high FROM fit" for i, name in enumerate(_NAMES, 1)) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT experiment, '{logit.RATIO_NAMES[name]}', round(exp(v), 3), round(exp(v - {Z} * se), 3), round(exp(v + {Z} * se), 3) FROM ratio WHERE ratio = '{name}'" for name, *_ in _RATIOS) + ") SELECT * FROM t"

_WIDE = [f"round(exp(b[{i}]), 3) AS \"odds_ratio_{name}\", round(exp(b[{i}] - {Z} * sqrt(c{i}{i})), 6) AS \"odds_ratio_{name}_ci_lower\", round(exp(b[{i}] + {Z} * sqrt(c{i}{i})), 6) AS \"odds_ratio_{name}_ci_upper\"" for i, name in enumerate(_NAMES, 1)]
for _name, _i, _j, _sign in _RATIOS:
    _v, _se, _as = f"({_sign} * b[{_i}] + b[{_j}])", f"sqrt(c{_i}{_i} + c{_j}{_j} + {2 * _sign} * c{_i}{_j})", f"odds_ratio_{logit.RATIO_NAMES[_name]}"
    _WIDE.append(f"round(exp({_v}), 3) AS \"{_as}\", round(exp({_v} - {Z} * {_se}), 3) AS \"{_as}_ci_lower\", round(exp({_v} + {Z} * {_se}), 3) AS \"{_as}_ci_upper\"")
REPORT = FIT + "SELECT experiment, " + ", ".join(_WIDE) + " FROM fit"

LOG = STATISTICS.rsplit("SELECT experiment, true AS converged", 1)[0].rstrip() + ", " + _TERM[len(FIT):].lstrip(", ").rstrip() + f""",
ln_(experiment, place, line) AS (SELECT experiment, 0, experiment || ': ' || n::BIGINT || ' rows, ' || g::BIGINT || ' questions, converged' FROM lx
UNION ALL SELECT experiment, 1, printf('log-likelihood %.4f, null %.4f, pseudo R2 %.4f, AIC %.4f, BIC %.4f', llf, llnull, 1 - llf / llnull, 12 - 2 * llf, 6 * ln(n) - 2 * llf) FROM lx
UNION ALL SELECT experiment, 2 + list_position({logit.TERMS!r}, term) - 1, term || printf(' %.4f %.4f %.3f %.4f [%.4f, %.4f]', estimate, se, z, {tail('a')}, estimate - {Z} * se, estimate + {Z} * se) FROM tz)
SELECT experiment, place, line FROM ln_"""
