"""Filter interaction audit by inclusion and exclusion.

For each set of filters the rows that fail all of them are counted as the sum of the product of their flags: 32
joint-failure counts for five filters, which is all that the audit needs from the rows. Möbius inversion turns
them into what survives each set of filters, so what any order of filters keeps and removes at each step, and
into the rows that fail one filter only; the signed joint counts are the Harsanyi dividends of the game whose
value is the number of rows removed, so their shares sum to each filter's Shapley value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import SPACE, computed, table, written

FILTERS = "ABCDE"


def subsets(filters: str) -> list[str]:
    """All sets of filters; the place of each is the sum of its filters' bits."""
    return ["".join(f for i, f in enumerate(filters) if mask >> i & 1) for mask in range(1 << len(filters))]


def joint_failures(rows: DataFrame, filters: str, part: str, measures: list[str]) -> DataFrame:
    """One row for each part: ``part`` and for each measure (a long column of ``rows``) the array of its sums
    over the rows that fail every filter of each set. The flags are the columns named as the filters."""
    product = lambda s, m: reduce(lambda x, f: x * F.col(f).cast("long"), s, F.col(m))
    sums = {m: [F.coalesce(F.sum(product(s, m)), F.lit(0)).cast("long") for s in subsets(filters)] for m in measures}
    return rows.groupBy(part).agg(*(F.array(*c).alias(m) for m, c in sums.items()))


def signed(joint: Column, k: int, counts: Callable[[Column], Column], weight: int | None = None) -> Column:
    """The sum of the joint counts over the sets (as bits) that count, signed by their size; with a ``weight``
    each set has it in equal shares among its filters."""
    size = F.bit_count
    share = lambda s: F.lit(1) if weight is None else (F.lit(weight) / F.greatest(size(s), F.lit(1))).cast("long")
    term = lambda s: F.when(counts(s), (1 - 2 * (size(s) % 2)) * share(s) * F.get(joint, s)).otherwise(0)
    return F.aggregate(F.sequence(F.lit(0), F.lit((1 << k) - 1)), F.lit(0).cast("long"), lambda x, s: x + term(s).cast("long"))


def survivors(joint: Column, k: int) -> Column:
    """For each set of filters the rows that pass all of them."""
    return F.transform(F.sequence(F.lit(0), F.lit((1 << k) - 1)), lambda whole: signed(joint, k, lambda s: s.bitwiseAND(whole) == s))


def unique_failures(joint: Column, k: int) -> Column:
    """For each filter the rows that fail no other one."""
    return F.array(*(-signed(joint, k, lambda s, bit=1 << i: s.bitwiseAND(F.lit(bit)) > 0) for i in range(k)))


def shapley_values(joint: Column, k: int) -> Column:
    """For each filter what it removes, summed over all orders: each set's Harsanyi dividend in equal shares."""
    return F.array(*(-signed(joint, k, lambda s, bit=1 << i: s.bitwiseAND(F.lit(bit)) > 0, factorial(k)) for i in range(k)))


def audit(rows: DataFrame, filters: str, part: str = "part", n: str = "n", lost: dict[str, str] | None = None) -> DataFrame:
    """One row for each part, order of all filters (``filter_order``) and ``step`` from 1: ``kept`` after it,
    ``removed`` by it, ``redundant`` (fail its filter, removed before), ``unique_fails`` (fail its filter only),
    ``shapley`` (its filter's removed, summed over all orders), and for each entry (name: column of ``rows``) of
    ``lost`` how many rows of that kind the step removes.

    ``rows`` has ``n`` equal rows each, with a boolean column for each filter, whose name is one letter. Only one
    row a part leaves the aggregate; orders are made after it. No rows, no parts. A null flag or count is an error
    of the caller's; a null part is a part.
    """
    lost = lost or {}
    counts = joint_failures(rows.select(F.col(part).alias("part"), *filters, F.col(n).alias("_n"), *(F.col(c).cast("long").alias(f"_{k}") for k, c in lost.items())), filters, "part", ["_n", *(f"_{k}" for k in lost)])
    size, all_ = len(filters), F.col("_n")
    kept = computed(counts, {"_kept": survivors(all_, size), "_unique": unique_failures(all_, size), "_shapley": shapley_values(all_, size), **{f"_{k}_kept": survivors(F.col(f"_{k}"), size) for k in lost}})
    orders = F.array(*(F.lit("".join(p)) for p in permutations(filters)))
    steps = kept.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    place = lambda at: F.instr(F.lit(filters), F.substring("filter_order", at, F.lit(1))) - 1
    mask = lambda upto: F.aggregate(F.filter(F.sequence(F.lit(1), F.lit(len(filters))), lambda k: k <= upto), F.lit(0), lambda m, k: m + F.pow(F.lit(2), place(k)).cast("int"))
    steps = computed(steps, {"_at": place(F.col("step")), "_before": mask(F.col("step") - 1), "_after": mask(F.col("step"))})
    at = lambda c, k: F.get(F.col(c), F.col(k))
    removed = at("_kept", "_before") - at("_kept", "_after")
    failing = F.get(F.col("_n"), F.pow(F.lit(2), F.col("_at")).cast("int"))
    return steps.select(
        "part", "filter_order", "step", at("_kept", "_after").alias("kept"), removed.alias("removed"), (failing - removed).alias("redundant"), at("_unique", "_at").alias("unique_fails"),
        *((at(f"_{k}_kept", "_before") - at(f"_{k}_kept", "_after")).alias(k) for k in lost), at("_shapley", "_at").alias("shapley"))


def text_failures(docs: DataFrame, text: str = "_text") -> DataFrame:
    """Adds the flags A to D of a text that is not null: under 100 words; under 80 % distinct words; over 10 %
    capital letters A-Z; a symbol of ``#$%&*|``."""
    t = F.col(text)
    docs = computed(docs, {"_words": F.array_remove(F.split(t, f"{SPACE}+"), "")})
    capitals = F.length(F.regexp_replace(t, "[^A-Z]+", ""))
    return docs.withColumns({
        "A": F.size("_words") < 100,
        "B": F.size(F.array_distinct("_words")) * 100 < F.size("_words") * 80,
        "C": capitals * 100 > F.length(t) * 10,
        "D": t.rlike("[#$%&*|]"),
    }).drop("_words")


def judged_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Counts of equal rows: ``part, A, B, C, D, E, n, good, toxic``; ``E``: the text is identical to that of a
    smaller key anywhere in the table.

    A null text counts as empty, a null part as the empty string. A row with a null key copies nothing and is
    nobody's original; repeated rows of one key count each, and a key's own rows do not copy each other. A key is
    good or toxic if any row of ``labels`` says so. Texts are compared by their SHA-256, and only digests are
    shuffled. Copies are counted before they meet, so a text or key with any share of the rows makes a few rows a
    task; null keys are joined by their digests.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    flags = text_failures(docs.select(F.col(key).alias("_key"), t.alias("_text"), F.coalesce(F.col(part), F.lit("")).alias("part")))
    flags = flags.select("_key", "part", F.sha2("_text", 256).alias("_digest"), *"ABCD")
    rows = flags.groupBy("_key", "part", "_digest", *"ABCD").agg(F.count("*").alias("n"))
    told = labels.groupBy(F.col(key).alias("_of")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic")).where("_of is not null")
    rows = rows.withColumn("_apart", F.when(F.col("_key").isNull(), F.col("_digest")).otherwise(F.lit("")))
    rows = rows.join(told.withColumn("_none", F.lit("")), (F.col("_key") == F.col("_of")) & (F.col("_apart") == F.col("_none")), "left")
    first = F.min(F.when(F.col("_key").isNotNull(), F.struct("_key", "n"))).alias("_first")
    nobody = F.sum(F.when(F.col("_key").isNull(), F.col("n")).otherwise(F.lit(0))).alias("_nobody")
    texts = rows.groupBy("_digest", "part", *"ABCD", F.coalesce("good", F.lit(0)).alias("_good"), F.coalesce("toxic", F.lit(0)).alias("_toxic")).agg(F.sum("n").alias("_all"), first, nobody)
    texts = written(texts, "texts")
    originals = texts.groupBy("_digest").agg(F.min("_first._key").alias("_original"))
    texts = texts.join(originals, "_digest")
    own = F.when(F.col("_first._key") == F.col("_original"), F.col("_first.n")).otherwise(F.lit(0))
    texts = texts.withColumn("_pass", F.col("_nobody") + own)
    both = F.explode(F.array(F.struct(F.lit(False).alias("E"), F.col("_pass").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("_all") - F.col("_pass")).alias("n")))).alias("x")
    return texts.select("part", *"ABCD", both, "_good", "_toxic").select("part", *"ABCD", "x.E", "x.n", (F.col("x.n") * F.col("_good")).alias("good"), (F.col("x.n") * F.col("_toxic")).alias("toxic"))


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit(rows, FILTERS, lost={"good_lost": "good", "toxic_lost": "toxic"})


OP12_SQL = """
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS s FROM documents),
w AS (SELECT *, list_filter(string_split_regex(s, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words, length(regexp_replace(s, '[^A-Z]+', '', 'g')) AS capitals FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END + CASE WHEN 100 * capitals > 10 * length(s) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(s, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY s) THEN 16 ELSE 0 END AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
cell AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM g GROUP BY part, fails),
f(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
st(step) AS (VALUES (1), (2), (3), (4), (5)),
os AS (SELECT filter_order, step, bits[step] AS own, CASE WHEN step > 1 THEN bits[1] ELSE 0 END + CASE WHEN step > 2 THEN bits[2] ELSE 0 END + CASE WHEN step > 3 THEN bits[3] ELSE 0 END + CASE WHEN step > 4 THEN bits[4] ELSE 0 END AS before FROM o, st),
x AS (SELECT part, filter_order, step, own,
    sum(CASE WHEN fails & (before | own) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails & before = 0 AND fails & own > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails & before > 0 AND fails & own > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails & before = 0 AND fails & own > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails & before = 0 AND fails & own > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cell, os GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM x
"""
