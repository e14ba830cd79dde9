"""Logistic regression of correctness on sources, with covariance clustered by question.

The design has at most 18 distinct rows an experiment, so Spark aggregates them once for all fits and once
more, per question, for the scores; the Newton steps run on the driver over those few rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.session import written

TERMS = ["const", "P_i", "U_present", "D_present", "U_correct", "D_correct"]


def design(merged: DataFrame) -> DataFrame:
    """``y`` and the terms as 0/1; flags must not be null."""
    bit = lambda c: F.col(c).cast("int")
    return merged.select("experiment", "qid", bit("output_correct").alias("y"), F.lit(1).alias("const"), bit("model_correct").alias("P_i"), bit("user_present").alias("U_present"), bit("doc_present").alias("D_present"), (bit("user_present") * bit("user_correct")).alias("U_correct"), (bit("doc_present") * bit("doc_correct")).alias("D_correct"))


def design_counts(merged: DataFrame) -> DataFrame:
    return design(merged).groupBy("experiment", *TERMS[1:]).agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("correct"))


@dataclass
class Fit:
    beta: np.ndarray
    cov: np.ndarray
    converged: bool
    n: int
    clusters: int
    llf: float
    llnull: float

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.diag(self.cov))


def newton(x: np.ndarray, n: np.ndarray, s: np.ndarray, steps: int = 50) -> tuple[np.ndarray, np.ndarray, bool]:
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        h = x.T @ (x * (n * p * (1 - p))[:, None])
        try:
            move = np.linalg.solve(h, x.T @ (s - n * p))
        except np.linalg.LinAlgError:
            return beta, h, False
        beta = beta + move
        if not np.isfinite(beta).all() or np.abs(beta).max() > 50:
            return beta, h, False
        if np.abs(move).max() < 1e-10:
            p = 1 / (1 + np.exp(-(x @ beta)))
            return beta, x.T @ (x * (n * p * (1 - p))[:, None]), True
    return beta, h, False


def null_space(a: np.ndarray, least: float = 1e-9) -> np.ndarray:
    """Orthonormal columns of the directions that no row of ``a`` sees."""
    if not len(a):
        return np.eye(a.shape[1])
    _, values, v = np.linalg.svd(a)
    return v[int((values > least).sum()) :].T


def separating_rays(x: np.ndarray, n: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Directions along which the likelihood never falls and somewhere rises, as columns: the extreme rays of the cone
    of directions that cells with successes only do not lower, those with failures only do not raise, and mixed ones do
    not see. Empty if the estimate is finite in all directions that the rows tell apart.

    A ray makes all but one of the cone's dimensions of cells equal to zero, so each choice of that many cells
    is tried: at most 8,568 choices of 18 cells.
    """
    mixed = (s > 0) & (s < n)
    seen = np.linalg.svd(x, full_matrices=False)[2][: np.linalg.matrix_rank(x)].T  # directions that the rows see
    free = seen @ null_space(x[mixed] @ seen)
    if not free.shape[1]:
        return free
    pure = np.unique(np.where(s[~mixed] > 0, 1.0, -1.0)[:, None] * x[~mixed], axis=0) @ free
    dims, rays = free.shape[1], []
    for tight in combinations(range(len(pure)), dims - 1):
        for d in null_space(pure[list(tight)].reshape(-1, dims)).T if len(tight) else np.eye(1):
            for sign in (1, -1):
                gains = sign * pure @ d
                if gains.min(initial=0) > -1e-9 and gains.max(initial=0) > 1e-9:
                    rays.append(sign * free @ d)
    return np.array(rays).reshape(-1, x.shape[1]).T


def states(x: np.ndarray, n: np.ndarray, s: np.ndarray) -> list[str]:
    """For each term ``unidentified`` (it changes along a direction that no row sees), ``separated`` (its estimate
    runs away along a direction that only improves the fit), or ``finite``."""
    unseen, rays = null_space(x), separating_rays(x, n, s)
    moved = lambda d, i: bool(d.shape[1] and np.abs(d[i]).max() > 1e-6)
    return ["unidentified" if moved(unseen, i) else "separated" if moved(rays, i) else "finite" for i in range(x.shape[1])]


def term_states(merged: DataFrame) -> list[tuple[str, str, str]]:
    """(experiment, term, state) of every experiment: why a fit did not converge, by name of term."""
    cells: dict[str, list] = {}
    for r in design_counts(merged).collect():  # at most 18 rows an experiment
        cells.setdefault(r["experiment"], []).append(([1, *(r[t] for t in TERMS[1:])], r["n"], r["correct"]))
    out = []
    for name, own in sorted(cells.items()):
        x, n, s = (np.array(c, float) for c in zip(*own, strict=True))
        out += [(name, t, state) for t, state in zip(TERMS, states(x, n, s), strict=True)]
    return out


def fits(merged: DataFrame, small_sample: bool = True) -> dict[str, Fit]:
    """The fit of every experiment, from one pass over the table and two grouped ones over its design. Estimates are
    nan (``converged`` false) where the terms cannot be told apart or some are separated (:func:`term_states`)."""
    spark = merged.sparkSession
    merged = written(design(merged), "design")  # 0/1 columns, read for the counts and for the scores
    rows = merged.groupBy("experiment", *TERMS[1:]).agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("correct")).collect()  # at most 18 rows an experiment
    cells: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["experiment"], *(r[t] for t in TERMS[1:]))):
        cells.setdefault(r["experiment"], []).append(r)
    out: dict[str, Fit] = {}
    solved, table = {}, []
    for name, own in cells.items():
        x = np.array([[1, *(r[t] for t in TERMS[1:])] for r in own], float)
        n, s = np.array([r["n"] for r in own], float), np.array([r["correct"] for r in own], float)
        total, k = int(n.sum()), x.shape[1]
        rate = s.sum() / total
        null = float(s.sum() * math.log(rate) + (total - s.sum()) * math.log(1 - rate)) if 0 < rate < 1 else 0.0
        beta, h, good = newton(x, n, s)
        if not good or np.linalg.cond(h) > 1e12:
            out[name] = Fit(np.full(k, np.nan), np.full((k, k), np.nan), False, total, 0, float("nan"), null)
            continue
        p = 1 / (1 + np.exp(-(x @ beta)))
        solved[name] = (beta, np.linalg.inv(h), total, float((s * np.log(p) + (n - s) * np.log1p(-p)).sum()), null)
        table += [(name, *map(int, row[1:]), float(q)) for row, q in zip(x, p, strict=True)]
    if not solved:
        return out
    known = spark.createDataFrame(table, "experiment string, " + ", ".join(f"{t} int" for t in TERMS[1:]) + ", p double")
    df = merged.join(F.broadcast(known), ["experiment", *TERMS[1:]])  # at most 18 rows an experiment
    scores = df.groupBy("experiment", "qid").agg(*(F.sum(F.col(t) * (F.col("y") - F.col("p"))).alias(t) for t in TERMS))
    k = len(TERMS)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = scores.groupBy("experiment").agg(F.count("*").alias("g"), *(F.sum(F.col(TERMS[i]) * F.col(TERMS[j])).alias(f"m{i}_{j}") for i, j in pairs))
    for r in sums.collect():  # one row an experiment
        beta, bread, total, llf, null = solved[r["experiment"]]
        meat = np.zeros((k, k))
        for i, j in pairs:
            meat[i, j] = meat[j, i] = r[f"m{i}_{j}"]
        g = r["g"]
        factor = g / (g - 1) * (total - 1) / (total - k) if small_sample and g > 1 and total > k else 1.0
        out[r["experiment"]] = Fit(beta, factor * bread @ meat @ bread, True, total, g, llf, null)
    return out


def fit(merged: DataFrame, experiment: str, small_sample: bool = True) -> Fit | None:
    """The fit of one experiment; None without rows."""
    return fits(merged.where(F.col("experiment") == experiment), small_sample).get(experiment)


def coefficients(f: Fit, alpha: float = 0.05) -> list[tuple]:
    """term, estimate, se, z, p, low, high, odds ratio and its bounds; None where not estimated."""
    z0 = NormalDist().inv_cdf(1 - alpha / 2)
    out = []
    for t, b, se in zip(TERMS, f.beta, f.se, strict=True):
        if not f.converged:
            out.append((t, *[None] * 9))
            continue
        z = b / se if se else float("nan")
        low, high = b - z0 * se, b + z0 * se
        out.append((t, *map(float, (b, se, z, math.erfc(abs(z) / math.sqrt(2)), low, high, math.exp(b), math.exp(low), math.exp(high)))))
    return out


def combined(f: Fit, a: str, b: str, sign: int, alpha: float = 0.05) -> tuple[float, float, float] | None:
    """exp(sign * a + b) with its interval: the composite odds ratio (1) or the selectivity (-1)."""
    if not f.converged:
        return None
    i, j = TERMS.index(a), TERMS.index(b)
    value = sign * f.beta[i] + f.beta[j]
    se = math.sqrt(max(0.0, f.cov[i, i] + f.cov[j, j] + 2 * sign * f.cov[i, j]))
    z0 = NormalDist().inv_cdf(1 - alpha / 2)
    return math.exp(value), math.exp(value - z0 * se), math.exp(value + z0 * se)


def odds(f: Fit) -> dict[str, tuple[float, float, float] | None]:
    return {f"{s}_{what}": combined(f, f"{c}_present", f"{c}_correct", sign) for s, c in (("user", "U"), ("doc", "D")) for what, sign in (("composite", 1), ("selectivity", -1))}


def statistics(f: Fit) -> dict[str, float | int | bool | None]:
    k = len(TERMS)
    if not f.converged:
        return {"converged": False, "n": f.n, "clusters": f.clusters, "df": k - 1, "pseudo_r2": None, "llf": None, "llnull": f.llnull, "llr_p": None, "aic": None, "bic": None}
    x = max(0.0, 2 * (f.llf - f.llnull))
    tail = math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)  # chi-square, 5 degrees
    return {"converged": True, "n": f.n, "clusters": f.clusters, "df": k - 1, "pseudo_r2": 1 - f.llf / f.llnull if f.llnull else None, "llf": f.llf, "llnull": f.llnull, "llr_p": tail, "aic": 2 * k - 2 * f.llf, "bic": k * math.log(f.n) - 2 * f.llf}


# Names of the odds table.
ODDS_NAMES = {
    "const": "intercept",
    "P_i": "βP_parametric_correctness",
    "U_present": "δU_user_display_effect",
    "D_present": "δD_doc_display_effect",
    "U_correct": "βU_user_correct_boost",
    "D_correct": "βD_doc_correct_boost",
}
RATIO_NAMES = {"user_composite": "user_correct_composite", "doc_composite": "doc_correct_composite", "user_selectivity": "user_selectivity", "doc_selectivity": "doc_selectivity"}


def odds_table(f: Fit) -> list[tuple[str, float | None, float | None, float | None]]:
    """(name, ratio, low, high) to three decimals: one odds ratio a term, then composites and selectivities;
    only these have bounds there."""
    r3 = lambda x: None if x is None else round(x, 3)
    rows = [(ODDS_NAMES[c[0]], r3(c[7]), None, None) for c in coefficients(f)]
    return rows + [(RATIO_NAMES[k], *(map(r3, v) if v else (None,) * 3)) for k, v in odds(f).items()]


def report_rows(found: dict[str, Fit]) -> list[tuple[str, str, float | None]]:
    """(experiment, metric, value) for the cross-experiment report: each ratio with its bounds."""
    out = []
    for e, f in sorted(found.items()):
        bounds = {ODDS_NAMES[c[0]]: c[8:] for c in coefficients(f)}
        for name, ratio, low, high in odds_table(f):
            low, high = (low, high) if name not in bounds else bounds[name]
            out += [(e, f"odds_ratio_{name}", ratio), (e, f"odds_ratio_{name}_ci_lower", low), (e, f"odds_ratio_{name}_ci_upper", high)]
    return out


def summary_lines(name: str, f: Fit) -> list[str]:
    """The log of one regression as text: its statistics, then one line a term (estimate, error, z, p, interval)."""
    s = statistics(f)
    out = [f"{name}: {f.n} rows, {s['clusters']} questions, {'converged' if f.converged else 'not converged'}"]
    if f.converged:
        out.append(f"log-likelihood {f.llf:.4f}, null {f.llnull:.4f}, pseudo R2 {s['pseudo_r2'] or 0:.4f}, AIC {s['aic']:.4f}, BIC {s['bic']:.4f}")
        out += [f"{t} {b:.4f} {se:.4f} {z:.3f} {p:.4f} [{low:.4f}, {high:.4f}]" for t, b, se, z, p, low, high, *_ in coefficients(f)]
    return out
