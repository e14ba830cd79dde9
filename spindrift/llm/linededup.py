"""Line dedup by winnowing over line hashes, with DataFrame functions only.

A document is its lines that hold a word. A window is the fewest lines that hold ``min_words`` words
together, counted on from its first line or back from its last one. Each window selects the line of its
smallest hash; the selected positions, each once, are the document's fingerprints. Any run of at least that
many words which two places share holds a window whole, so both places select the same line there.

Selected positions are joined on their fingerprint: those of one place alone go, with their windows. Around
the others the windows are compared as a whole, each with the first place that holds it, so a hot line makes
no pairs of places. A run that an earlier place holds too is the union of its windows counted on and counted
back: a line of it lies in the window that starts there or, where that would end beyond the run, in the one
that ends with the run. So matches reach both ways to the ends of every run, whichever earlier places hold
them, and no place has to be compared with another line by line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm.common import SPACE, SPACES, computed, table, written

MIN_WORDS = 50


def line_table(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with a window: ``id``, ``k`` (hash of the text: tells rows of one id apart), hashes
    ``h`` of its lines with a word (white space at their ends aside), and the lines of the window counted on
    (``f``) and counted back (``b``) from each, 0 where the text ends before ``min_words`` words."""
    df = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.xxhash64(text).alias("k"), _lines(text).alias("l"))
    trimmed = F.transform("l", lambda x: F.trim(x, F.lit(SPACES)))
    counted = F.transform("l", lambda x: F.regexp_count(x, F.lit("[^" + SPACE[1:] + "+")))
    df = computed(df, {"h": F.transform(trimmed, lambda x: F.xxhash64(x)), "n": counted}).drop("l")
    df = df.where(F.expr(f"aggregate(n, 0L, (s, x) -> s + x) >= {min_words}"))

    def reach(n: str) -> str:
        def within(most: int) -> str:  # words in the upper half of a number, lines in the lower one
            return f"aggregate(slice({n}, i, {most}), 0L, (a, x) -> if(shiftright(a, 32) >= {min_words}, a, a + shiftleft(cast(x as bigint), 32) + 1), a -> if(shiftright(a, 32) >= {min_words}, cast(a & {(1 << 32) - 1} as int), null))"

        short = min(8, min_words)
        return f"transform(sequence(1, size(h)), i -> coalesce({within(short)}, if(i + {short} > size(h) + 1, 0, coalesce({within(min_words)}, 0))))"

    made = computed(computed(df, {"r": F.reverse("n")}), {"f": F.expr(reach("n")), "b": F.expr(reach("r"))})
    return made.select("id", "k", "h", "f", F.reverse("b").alias("b"))


def _lines(text: str):
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0)


def windows(lines: DataFrame) -> DataFrame:
    """``id, k, i`` (first line, from 1), ``m`` (lines), ``fp`` (smallest line hash), ``at`` (the line that has
    it, the first of equals) and ``g`` (hash of the window)."""
    on = "filter(transform(f, (m, j) -> named_struct('i', j + 1, 'm', m)), s -> s.m > 0)"
    back = "filter(transform(b, (m, j) -> named_struct('i', j + 2 - m, 'm', m)), s -> s.m > 0 AND f[s.i - 1] <> s.m)"
    df = lines.select("id", "k", "h", F.expr(f"concat({on}, {back})").alias("s"))
    least = "transform(s, x -> named_struct('i', x.i, 'm', x.m, 'fp', array_min(slice(h, x.i, x.m)), 'g', xxhash64(slice(h, x.i, x.m))))"
    df = df.select("id", "k", "h", F.expr(f"inline({least})"))
    return df.select("id", "k", "i", "m", "fp", F.expr("cast(array_position(slice(h, i, m), fp) as int) + i - 1").alias("at"), "g")


def repeated_runs(lines: DataFrame) -> DataFrame:
    """Line ranges to delete: ``id, k, runs`` (array of (from, to), disjoint, lines counted from 1)."""
    found = written(windows(lines), "windows")
    chosen = F.struct("id", "k", "at")
    fingerprints = found.groupBy("fp").agg(F.min(chosen).alias("p"), F.max(chosen).alias("q")).where("p < q").select("fp")
    found = written(found.join(fingerprints, "fp").drop("at"), "shared")
    place = F.struct("id", "k", "i")
    first = found.groupBy("fp", "g").agg(F.min(place).alias("p"), F.max(place).alias("q")).where("p < q").select("fp", "g", "p")
    first = written(first, "first")  # apart from the join, so that a hot window's places can be split there
    hits = found.join(first, ["fp", "g"]).where(F.struct("id", "k", "i") > F.col("p"))
    spans = hits.select("id", "k", F.col("i").alias("a"), (F.col("i") + F.col("m") - 1).alias("b"))
    # overlapping and touching spans become one
    own = Window.partitionBy("id", "k").orderBy("a", "b")
    reached = F.max("b").over(own.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(F.col("a") <= reached + 1, 0).otherwise(1))
    spans = spans.withColumn("r", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    merged = spans.groupBy("id", "k", "r").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return merged.groupBy("id", "k").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Delete, from every document, the lines of all runs of at least ``min_words`` words that an earlier
    document or an earlier place of the same document holds too.

    Earlier means a smaller key, then a smaller hash of the text, then a smaller line number. Adds ``n_lines``,
    ``n_removed`` (lines with a word) and ``n_removed_words``; columns of those names are replaced, others
    carried. A document that loses lines also loses its lines without a word; others keep their text as it
    is. A document whose lines all go is left with an empty text. Null text stays null and has no lines.
    Rows with the same key and text are one document; rows with the same key and other text are two. A null
    key comes first. A text of any length is one row, with one step of at most ``min_words`` lines a line.
    An empty table stays empty.
    """
    docs = docs.drop("n_lines", "n_removed", "n_removed_words")
    # the runs grow with the corpus: always a shuffle join, so that every size runs the same plan
    runs = written(repeated_runs(line_table(docs, min_words, key, text)), "runs").hint("merge")
    out = docs.withColumn("_k", F.xxhash64(text)).join(runs.withColumnsRenamed({"id": "_id", "k": "_k0"}), F.col(key).eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_k0")), "left")
    out = out.withColumn("_l", F.coalesce(_lines(text), F.array().cast("array<string>")))
    kept = F.expr("filter(_l, (x, j) -> NOT exists(runs, r -> j + 1 BETWEEN r.a AND r.b))")
    gone = F.expr("flatten(transform(coalesce(runs, array()), r -> slice(_l, r.a, r.b - r.a + 1)))")
    words = F.aggregate(F.transform(gone, lambda x: F.regexp_count(x, F.lit("[^" + SPACE[1:] + "+"))), F.lit(0), lambda a, x: a + x)
    out = computed(out, {
        "n_lines": F.size("_l").cast("long"),
        "n_removed": F.size(gone).cast("long"),
        "n_removed_words": words.cast("long"),
        text: F.when(F.col("runs").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")),
    })
    return out.select(*docs.columns, "n_lines", "n_removed", "n_removed_words")


def op7_line_dedup_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "n_removed_words", "text")
