"""Quality rules: base statistics of whole texts and a learned decision list over them.

Sequential covering grows one conjunction of thresholds after another on two thirds of the labelled
rows (FOIL gain), prunes it on the rest, and stops when a rule is not precise enough there. The list
becomes one ordered ``CASE WHEN`` of Spark. A second list has the toxic label as its target; its
statistics include how often words learned from the labelled rows stand in a text. Both lists are fitted
on the same labelled rows, whose statistics are made once. DataFrame functions only on the executors; the fit runs on the driver over the statistics of at most ``max_labelled`` labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import SPACE, SPACES, computed, remove, table, written

SYMBOLS = "#*$%&|<>"
#: Labelled rows that the fit may see: those with the smallest hashes of their id.
MAX_LABELLED = 20_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["n_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share", "alpha_share", "digit_share", "words_per_line", "upper_share"]
#: What the toxic list sees besides; words that it learns at most, and toxic rows that must hold one.
WORD_FEATURES = ["n_toxic", "toxic_share"]
ALL_FEATURES = FEATURES + WORD_FEATURES
MAX_WORDS, LEAST_ROWS = 256, 5
#: Words from which a text's windows are sorted by their whole hash.
LONG = 1 << 16
NO_LETTERS = r"[^\p{L}]+"
DIGITS, CAPITALS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Every character by itself: Java's patterns look such a class up in a table, but test ranges one by one.
NOT_COUNTED = f"[^{SYMBOLS}{DIGITS}{CAPITALS}]+"


def text_counts(docs: DataFrame, text: str = "text", words: list[str] | None = None) -> DataFrame:
    """Adds the base counts, all long: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``
    and ``n_repeat_words``, and the helper counts the features need.

    A null text counts as empty: all zero; repeated rows count each; an empty table stays empty. A repeated
    3-word window is found by sorting 64-bit values that hold the window's hash above its position, so no
    text leaves its row and a text of any length is one sort. From ``LONG`` words on, where the position
    would leave the hash too few bits, pairs of the whole 64-bit hash and the position are sorted.
    ``words`` (lower case, letters only): also ``_toxic``, how many of the text's runs of letters are one of them.
    """
    def among(chars: str) -> Column:
        return (F.length("_few") - F.length(F.translate("_few", chars, ""))).cast("long")

    df = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    # the few characters that are counted by kind; translate looks each one up, so it gets these alone
    df = df.withColumn("_few", F.regexp_replace("_t", NOT_COUNTED, ""))
    df = df.withColumn("_r", F.split(F.lower("_t"), NO_LETTERS))
    df = df.withColumn("_w", F.filter(F.split("_t", SPACE + "+"), lambda w: w != "")).withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0))
    df = df.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.concat_ws("", "_w")).cast("long"),
        "n_symbols": among(SYMBOLS),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_lines": F.size("_l").cast("long"),
        "_distinct": F.size(F.array_distinct("_w")).cast("long"),
        "_digits": among(DIGITS),
        "_upper": among(CAPITALS),
        "_letters": F.length(F.concat_ws("", "_r")).cast("long"),
        "_bits": F.length(F.bin(F.size("_w").cast("long"))),
    })
    if words is not None:
        df = df.withColumn("_toxic", (F.size(F.filter("_r", lambda w: w.isin(words))) if words else F.lit(0)).cast("long"))
    window = "transform(sequence(1, size(_w) - 2), i -> {0})"
    hashed = "xxhash64(_w[i - 1], _w[i], _w[i + 1])"
    short, long = window.format(f"shiftleft({hashed}, _bits) | cast(i as bigint)"), window.format(f"struct({hashed} as h, cast(i as bigint) as i)")
    df = df.withColumns({
        "_s": F.expr(f"CASE WHEN size(_w) BETWEEN 3 AND {LONG - 1} THEN sort_array({short}) ELSE cast(array() as array<bigint>) END"),
        "_v": F.expr(f"CASE WHEN size(_w) >= {LONG} THEN sort_array({long}) ELSE cast(array() as array<struct<h:bigint,i:bigint>>) END"),
    }).drop("_w", "_r", "_l", "_t", "_few")
    # beyond either end there is null, which is not true
    equal = "filter({0}, (x, j) -> {1} OR {2})"
    same = "shiftrightunsigned(x ^ get(_s, j {0} 1), _bits) = 0"
    twice = equal.format("_s", same.format("-"), same.format("+"))
    pairs = equal.format("_v", "x.h = get(_v, j - 1).h", "x.h = get(_v, j + 1).h")
    df = df.withColumn("_p", F.expr(f"concat(transform({twice}, x -> x & (shiftleft(1L, _bits) - 1)), transform({pairs}, x -> x.i))")).drop("_s", "_v")
    repeated = F.size(F.array_distinct(F.flatten(F.transform("_p", lambda p: F.array(p, p + 1, p + 2))))).cast("long")
    names = [*COUNTS[:-1], "_lines", "_distinct", "_digits", "_upper", "_letters", *(["_toxic"] if words is not None else [])]
    return computed(df, {**{c: F.col(c) for c in names}, "n_repeat_words": repeated}).drop("_p", "_bits")


def features() -> dict[str, Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("_lines"), F.lit(1)).cast("double")
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_share": F.col("n_repeat_words") / words,
        "distinct_share": F.col("_distinct") / words,
        "alpha_share": F.col("_letters") / chars,
        "digit_share": F.col("_digits") / chars,
        "words_per_line": F.col("n_words") / lines,
        "upper_share": F.col("_upper") / chars,
        "n_toxic": F.col("_toxic").cast("double"),
        "toxic_share": F.col("_toxic") / words,
    }


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


Rule = tuple[Test, ...]


def _mask(rule: Rule, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for t in rule:
        v = x[:, ALL_FEATURES.index(t.feature)]
        hit &= v > t.threshold if t.above else v <= t.threshold
    return hit


def _grow(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], longest: int) -> Rule:
    rule: Rule = ()
    hit = np.ones(len(x), bool)
    while len(rule) < longest and not y[hit].all():
        p0, n0 = y[hit].sum(), (~y[hit]).sum()
        base, best, best_gain = np.log2(p0 / (p0 + n0)), None, 1e-9
        for f, values in enumerate(cuts):
            # rows covered by "v <= cut" for every cut at once
            order = np.searchsorted(values, x[hit, f], "left")
            p_le = np.cumsum(np.bincount(order[y[hit]], minlength=len(values) + 1))[:-1]
            n_le = np.cumsum(np.bincount(order[~y[hit]], minlength=len(values) + 1))[:-1]
            for above, p, n in ((False, p_le, n_le), (True, p0 - p_le, n0 - n_le)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), -1)
                if len(gain) and gain.max() > best_gain:
                    k = int(gain.argmax())
                    best_gain, best = gain[k], Test(ALL_FEATURES[f], above, float(values[k]))
        if best is None:
            break
        rule += (best,)
        hit = _mask(rule, x)
    return rule


def _prune(rule: Rule, x: np.ndarray, y: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        hit = _mask(r, x)
        p, n = (hit & y).sum(), (hit & ~y).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)


def fit_decision_list(x: np.ndarray, reject: np.ndarray, max_rules: int = 12, longest: int = 4, precision: float = 0.95, least: int = 5, cuts: int = 128, grow: np.ndarray | None = None) -> list[Rule]:
    """Ordered conjunctions that mark rows to reject. ``grow`` says which rows grow rules; the others prune
    (without it every third one). A rule must hold ``precision`` among at least ``least`` rows, on the growing and the
    pruning rows together and on the pruning rows alone, or the covering stops."""
    rules: list[Rule] = []
    grow = np.arange(len(x)) % 3 != 2 if grow is None else grow
    left = np.ones(len(x), bool)
    while len(rules) < max_rules and (reject & left & grow).any():
        xs, ys = x[left & grow], reject[left & grow]
        grid = [np.unique(np.quantile(xs[:, f], np.linspace(0, 1, cuts), method="lower")) for f in range(x.shape[1])]
        rule = _grow(xs, ys, grid, longest)
        if not rule:
            break
        rule = _prune(rule, x[left & ~grow], reject[left & ~grow])
        hit = _mask(rule, x) & left
        held = hit & ~grow
        if hit.sum() < least or reject[hit].mean() < precision or (held.any() and reject[held].mean() < precision):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def decision_column(rules: list[Rule]) -> Column:
    """True for rows that no rule rejects: one ordered CASE WHEN."""
    if not rules:
        return F.lit(True)
    out = None
    for rule in rules:
        cond = rule[0].column()
        for t in rule[1:]:
            cond &= t.column()
        out = F.when(cond, F.lit(False)) if out is None else out.when(cond, F.lit(False))
    return out.otherwise(F.lit(True))


@dataclass(frozen=True)
class ToxicList:
    words: list[str]
    rules: list[Rule]


def toxic_words(rows: DataFrame) -> list[str]:
    """Words of rows with ``_toxic_label``: at least ``LEAST_ROWS`` toxic rows and nine in ten of the rows with
    such a word are toxic; at most ``MAX_WORDS``, those of most toxic rows."""
    seen = rows.where("_toxic_label is not null").select("_toxic_label", F.explode(F.array_distinct(F.split(F.lower("text"), NO_LETTERS))).alias("w")).where("w <> ''")
    counts = seen.groupBy("w").agg(F.count_if(F.col("_toxic_label") == 1).alias("t"), F.count("*").alias("n"))
    best = counts.where((F.col("t") >= LEAST_ROWS) & (10 * F.col("t") >= 9 * F.col("n"))).orderBy(F.desc("t"), "n", "w").limit(MAX_WORDS)
    return [r["w"] for r in best.collect()]


def learn_lists(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[list[Rule], ToxicList | None]:
    """The list for ``quality = 0`` and the one for ``toxic = 1``, over at most ``max_labelled`` labelled
    documents (smallest hashes of the id).

    A row whose label is null does not count for that label's list; no rows: no rules, or None. An id with
    several labels counts as its lowest quality and as toxic if one says so, one with several texts as one of
    them (the least by its counts). The toxic list's words come from two thirds of the rows, which grow its
    rules too; the rest prunes.
    """
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)")
    chosen = known.groupBy("doc_id").agg(F.min("quality").alias("_quality_label"), F.max("toxic").alias("_toxic_label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = written(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "labelled")  # at most max_labelled labels of 16 bytes
    grow = F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 2
    words = toxic_words(rows.where(grow))
    stats = text_counts(rows, words=words).select("doc_id", "_quality_label", "_toxic_label", grow.alias("_grow"), F.array(*(features()[c] for c in ALL_FEATURES)).alias("f"))
    got = stats.groupBy("doc_id").agg(F.min(F.struct("_quality_label", "_toxic_label", "_grow", "f")).alias("s")).select("doc_id", "s.*").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    remove(docs.sparkSession, rows)
    rated = [r for r in got if r["_quality_label"] is not None]
    judged = [r for r in got if r["_toxic_label"] is not None]
    rules, toxic = [], None
    if rated:
        rules = fit_decision_list(np.array([r["f"][: len(FEATURES)] for r in rated], float), np.array([r["_quality_label"] == 0 for r in rated], bool))
    if judged:
        toxic = ToxicList(words, fit_decision_list(np.array([r["f"] for r in judged], float), np.array([r["_toxic_label"] == 1 for r in judged], bool), grow=np.array([r["_grow"] for r in judged], bool)))
    return rules, toxic


def learn_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """The quality list of :func:`learn_lists` alone; without labelled documents the base rules alone decide."""
    return learn_lists(docs, labels.withColumn("toxic", F.lit(None).cast("int")), max_labelled)[0]


def learn_toxic(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> ToxicList | None:
    """The toxic list of :func:`learn_lists` alone."""
    return learn_lists(docs, labels.withColumn("quality", F.lit(None).cast("int")), max_labelled)[1]


def judge_documents(docs: DataFrame, rules: list[Rule], toxic: ToxicList | None = None) -> DataFrame:
    """Adds the base counts, ``base_failed`` and ``kept`` to every row; columns of ``docs`` with those
    names are replaced, others carried. Rows that the toxic list marks are not kept either. Null and empty
    texts fail the base rules; repeated rows are judged each; an empty table stays empty."""
    words = toxic.words if toxic else []
    out = text_counts(docs.drop(*COUNTS, "base_failed", "kept"), words=words)
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & decision_column(rules) & decision_column(toxic.rules if toxic else []))
    return out.drop("_lines", "_distinct", "_digits", "_upper", "_letters", "_toxic")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    return judge_documents(docs, *learn_lists(docs, labels)).select("doc_id", *COUNTS, "base_failed", "kept")
