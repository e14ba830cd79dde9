"""DuckDB SQL of the registered queries: common table expressions for the fixture, then one text each."""

from __future__ import annotations

from spindrift.functions import dims
from spindrift.plans.fixtures import EXPERIMENTS


def _values(rows) -> str:
    def lit(v):
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


BASE = f"""
WITH ex(experiment, uw, dw) AS (VALUES {_values(EXPERIMENTS)}),
dim(probe_variant, up, dp, uc, dc, fst, variant_rank) AS (VALUES {_values([(*v, i) for i, v in enumerate(dims.VARIANTS)])}),
c(ci) AS (VALUES (0), (1), (2), (3), (4)),
q AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS qid, p_name AS question, p_brand AS concept, (p_partkey * 31 + 7) % 5 AS gi, p_partkey % 37 = 0 AS unk FROM part),
bl AS (SELECT q.*, ci, CASE WHEN unk THEN -100.0::DOUBLE ELSE ((((k + 1) * 7919 + ci * 104729) % 1009) / 100.0)::DOUBLE + CASE WHEN ci = gi THEN 2.0 ELSE 0.0 END END AS l FROM q, c),
bp AS (SELECT k, arg_max(ci, l * 1000000 - ci) FILTER (true) AS pi, arg_max(ci, l * 1000000 - ci) FILTER (ci <> gi) AS oi FROM bl GROUP BY k),
cw AS (SELECT q.*, CASE WHEN unk THEN CAST('0x' || substr(md5(qid), 1, 8) AS BIGINT) % 4 + CASE WHEN CAST('0x' || substr(md5(qid), 1, 8) AS BIGINT) % 4 >= gi THEN 1 ELSE 0 END WHEN pi <> gi THEN pi ELSE oi END AS wi, CASE WHEN unk THEN NULL ELSE pi END AS bi FROM q JOIN bp USING (k)),
vx AS (SELECT ex.*, dim.*, fst <> '' AND fst = 'u' AS user_first FROM ex, dim WHERE fst = '' OR (fst = 'u') = (split_part(experiment, '__', 3)[1] = 'u')),
ll AS (SELECT vx.*, cw.k, cw.qid, cw.question, cw.concept, cw.gi, cw.wi, cw.bi, cw.unk, bl.ci,
  CASE WHEN cw.unk THEN bl.l ELSE bl.l + (CASE WHEN up AND bl.ci = CASE WHEN uc THEN cw.gi ELSE cw.wi END THEN uw ELSE 0.0 END + CASE WHEN dp AND bl.ci = CASE WHEN dc THEN cw.gi ELSE cw.wi END THEN dw ELSE 0.0 END) END::DOUBLE AS l
  FROM vx, cw JOIN bl USING (k)),
ls AS (SELECT *, max(l) OVER (PARTITION BY experiment, probe_variant, k) AS top FROM ll),
lp AS (SELECT *, exp(l - top) / sum(exp(l - top)) OVER (PARTITION BY experiment, probe_variant, k) AS p FROM ls),
m AS (SELECT experiment, probe_variant, variant_rank, user_first, up AS user_present, dp AS doc_present, uc AS user_correct, dc AS doc_correct, k, qid, question, concept, gi, wi, unk,
  max(p) AS max_prob,
  CASE WHEN unk THEN 'UNKNOWN' ELSE chr((65 + arg_max(ci, l * 1000000 - ci))::INTEGER) END AS output_letter, chr((65 + gi)::INTEGER) AS gold, chr((65 + wi)::INTEGER) AS canonical_wrong,
  CASE WHEN bi IS NULL THEN 'UNKNOWN' ELSE chr((65 + bi)::INTEGER) END AS bare_letter,
  NOT unk AND coalesce(bi = gi, false) AS model_correct, coalesce(NOT unk AND arg_max(ci, l * 1000000 - ci) = gi, false) AS output_correct,
  max(p) FILTER (ci = gi) AS pg, max(p) FILTER (ci = wi) AS pw, 1e0 * sum(p) - max(p) FILTER (ci = gi) - max(p) FILTER (ci = wi) AS po
  FROM lp GROUP BY ALL)
""".replace("GROUP BY ALL", "GROUP BY experiment, probe_variant, variant_rank, user_first, up, dp, uc, dc, k, qid, question, concept, gi, wi, bi, unk")

SINGLE = BASE + """,
s AS (SELECT *, CASE WHEN probe_variant[1] = 'u' THEN 'user' ELSE 'document' END AS source, CASE WHEN probe_variant[1] = 'u' THEN user_correct ELSE doc_correct END AS sc FROM m WHERE probe_variant IN ('upos', 'uneg', 'dpos', 'dneg')),
r AS (SELECT *, CASE WHEN sc THEN gold ELSE canonical_wrong END AS suggestion FROM s),
f AS (SELECT *, suggestion <> bare_letter AS conflict, output_letter = bare_letter AS stick, output_letter = suggestion AS adopt, NOT model_correct AND sc AS pb, model_correct AND NOT sc AS cb FROM r),
cm AS (SELECT experiment, probe_variant, source, count(*) AS n_present, count(*) FILTER (conflict) AS n_conflict, count(*) FILTER (pb) AS n_prior, count(*) FILTER (cb) AS n_context,
  count(*) FILTER (conflict AND stick) / nullif(count(*) FILTER (conflict), 0)::DOUBLE AS own_answer_rate,
  count(*) FILTER (conflict AND adopt) / nullif(count(*) FILTER (conflict), 0)::DOUBLE AS context_answer_rate,
  count(*) FILTER (conflict AND stick) / nullif(count(*) FILTER (conflict AND stick) + count(*) FILTER (conflict AND adopt), 0)::DOUBLE AS memory_ratio,
  count(*) FILTER (pb AND stick) / nullif(count(*) FILTER (pb), 0)::DOUBLE AS prior_bias,
  count(*) FILTER (pb AND adopt) / nullif(count(*) FILTER (pb), 0)::DOUBLE AS prior_correction,
  count(*) FILTER (pb AND NOT stick AND NOT adopt) / nullif(count(*) FILTER (pb), 0)::DOUBLE AS prior_neither,
  count(*) FILTER (cb AND adopt) / nullif(count(*) FILTER (cb), 0)::DOUBLE AS context_bias,
  count(*) FILTER (cb AND stick) / nullif(count(*) FILTER (cb), 0)::DOUBLE AS context_robustness,
  count(*) FILTER (cb AND NOT stick AND NOT adopt) / nullif(count(*) FILTER (cb), 0)::DOUBLE AS context_neither
  FROM f GROUP BY experiment, probe_variant, source)
"""

SHIFT = BASE + """,
z AS (SELECT *, pg + 1e-9 + pw + 1e-9 + po + 1e-9 AS t FROM m),
v AS (SELECT experiment, probe_variant, qid, (pg + 1e-9) / t AS a, (pw + 1e-9) / t AS b, (po + 1e-9) / t AS o FROM z),
d AS (SELECT v.*, -(v.a * log2(v.a) + v.b * log2(v.b) + v.o * log2(v.o)) AS h, w.a AS a0, w.b AS b0, w.o AS o0, -(w.a * log2(w.a) + w.b * log2(w.b) + w.o * log2(w.o)) AS h0 FROM v JOIN v w ON w.experiment = v.experiment AND w.qid = v.qid AND w.probe_variant = 'bare'),
e AS (SELECT *, (log2(a) + log2(b) + log2(o)) / 3 AS mx, (log2(a0) + log2(b0) + log2(o0)) / 3 AS my FROM d),
g AS (SELECT *, (log2(a) - mx) * (log2(a0) - my) + (log2(b) - mx) * (log2(b0) - my) + (log2(o) - mx) * (log2(o0) - my) AS sxy, (log2(a) - mx) ** 2 + (log2(b) - mx) ** 2 + (log2(o) - mx) ** 2 AS sxx, (log2(a0) - my) ** 2 + (log2(b0) - my) ** 2 + (log2(o0) - my) ** 2 AS syy FROM e),
sh AS (SELECT experiment, probe_variant, qid, a * log2(a / a0) + b * log2(b / b0) + o * log2(o / o0) AS kl, h - h0 AS delta_entropy, log2(a0) - log2(a) AS delta_neglogp, CASE WHEN sqrt(sxx / 3) > 1e-6 AND sqrt(syy / 3) > 1e-6 THEN sxy / sqrt(sxx * syy) END AS pearson FROM g WHERE probe_variant <> 'bare')
"""


def rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


FAMILY = "CASE " + " ".join(f"WHEN starts_with(key, '{p}') THEN '{f}'" for p, f in dims.FAMILIES) + " ELSE split_part(key, '_', 1) END"
STRENGTH = "CASE {} WHEN 'w' THEN 'weak' WHEN 'n' THEN 'neutral' WHEN 'c' THEN 'confident' END"
