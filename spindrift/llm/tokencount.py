"""Token counts of whole texts under a byte-level BPE of the ``tokenizers`` library.

Merges never cross a pre-token, so a text's token count is the sum over its pre-tokens of their piece
counts. One pass over the texts gives the distinct pre-tokens of the corpus with their frequencies; the
pieces of each are counted once. A second pass turns every document into its pre-token frequencies and
joins them with the piece counts: the most frequent pre-tokens, a bounded table, by a broadcast where the
document is read (long ones by their MD5), all others by a shuffle. So no hot pre-token meets a reducer, and what is
shuffled is only the rare ones. A pre-token of thousands of characters, such as a picture in base64, is counted where
it stands instead. The products are summed by document; no list of ids is made for any document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import table, written

#: Pre-tokens that a task holds before it passes them on, and characters of the texts they are from; pre-tokens whose
#: piece counts are broadcast.
HELD, HELD_CHARS, BROADCAST = 400_000, 1 << 25, 200_000
#: Characters of a pre-token beyond which it is broadcast by its MD5, and beyond which it is counted where it stands.
LONG, LONGEST = 64, 4_096
#: Characters of the pre-tokens that are encoded together.
TOGETHER = 1 << 18


class PieceCounter:
    """Counts for one tokenizer file; ``path`` must exist on every executor."""

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        spec = json.load(open(path, encoding="utf-8"))
        kind = spec["pre_tokenizer"]
        if spec["normalizer"] is not None or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or not kind["use_regex"] or spec["model"]["type"] != "BPE":
            raise ValueError("a byte-level BPE without normalizer or prefix space is needed")
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens must match as they stand")
        self.splitter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.pieces = Tokenizer.from_file(path)
        self.pieces.encode_special_tokens = True
        self.pieces.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pieces.no_truncation()
        self.pieces.no_padding()
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        # The characters below U+02B0 by their classes; others go to the library's own splitter
        letters, spaces = "A-Za-zªµºÀ-ÖØ-öø-ʯ", "\\t-\\r \x85\xa0"
        self.settled = re.compile(f"[^\\x00-\\x1b\\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ʯ\u2010-\u2027\u20ac]").search
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[0-9]+| ?[^{spaces}{letters}0-9]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+").findall

    def pre_tokens(self, text: str) -> list[str]:
        """As the library splits: by the pattern above where all characters are in it, else by itself."""
        if self.settled(text):
            return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]
        return self.words(text)

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """How often each pre-token stands in a text, and how many special strings do."""
        if self.special is not None and (found := self.special.findall(text)):
            freq = Counter()
            for part in self.special.split(text):
                freq.update(self.pre_tokens(part))
            return freq, len(found)
        return Counter(self.pre_tokens(text)), 0

    def piece_counts(self, words: list[str]) -> list[int]:
        """Pieces of each pre-token; a few thousand are encoded at once, fewer if they are long."""
        out, first, chars = [], 0, 0
        for i, w in enumerate(words):
            chars += len(w)
            if chars >= TOGETHER or i - first >= 4095:
                out += map(len, self.pieces.encode_batch(words[first : i + 1], add_special_tokens=False))
                first, chars = i + 1, 0
        if first < len(words):
            out += map(len, self.pieces.encode_batch(words[first:], add_special_tokens=False))
        return out

    def count(self, texts: list[str]) -> list[int]:
        """Token counts of a few texts, pieces counted once for each distinct pre-token."""
        made = [self.frequencies(t) for t in texts]
        words = list({w for freq, _ in made for w in freq})
        known = dict(zip(words, self.piece_counts(words), strict=True))
        return [n + sum(c * known[w] for w, c in freq.items()) for freq, n in made]


_COUNTERS: dict[str, PieceCounter] = {}


def worker_counter(path: str) -> PieceCounter:
    """One counter in each Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def blocks(texts: list[str | None], most: int = 1 << 21) -> Iterator[list[str]]:
    """Runs of whole texts of about ``most`` characters; null is empty."""
    part, chars = [], 0
    for t in texts:
        part.append(t or "")
        chars += len(part[-1])
        if chars >= most:
            yield part
            part, chars = [], 0
    if part:
        yield part


def pre_token_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``w, n, pieces``: every distinct pre-token of the texts up to ``LONGEST`` characters, its frequency, and its
    pieces, counted once."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, held, chars = worker_counter(path), Counter(), 0

        def out() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["w", "n"])
            held.clear()
            return made

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    made = counter.frequencies(t)[0] if counter.special is not None and counter.special.search(t) else counter.pre_tokens(t)
                    if len(t) > LONGEST and max(map(len, made), default=0) > LONGEST:
                        made = {w: c for w, c in Counter(made).items() if len(w) <= LONGEST}
                    held.update(made)
                    chars += len(t)
                    if len(held) >= HELD or chars >= HELD_CHARS:
                        yield out()
                        chars = 0
        if held:
            yield out()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(path)
        for b in batches:
            yield pa.record_batch([*b.columns, pa.array(counter.piece_counts(b.column(0).to_pylist()), pa.int64())], ["w", "n", "pieces"])

    distinct = docs.select(text).mapInArrow(split, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return distinct.mapInArrow(pieces, "w string, n long, pieces long")


def token_counts(docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", text: str = "text", most: int = BROADCAST) -> DataFrame:
    """One row per row of ``docs``: key, ``n_bytes``, ``n_tokens``, ``over_limit``.

    Null and empty texts have no bytes and no tokens; special strings inside a text count as their one
    token, as the library's default has it; repeated rows count each; an empty table stays empty. Texts of
    any length count whole. Other columns are not carried. The piece counts of the ``most`` most frequent
    pre-tokens are broadcast, the others joined by a shuffle; those over ``LONGEST`` characters are counted in place.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    known = written(pre_token_counts(docs, path, text), "pieces")
    short = F.when(F.length("w") <= LONG, F.col("w"))
    named = known.select(short.alias("w"), F.when(short.isNull(), F.unhex(F.md5("w"))).alias("digest"), "n", "pieces")
    often = named.orderBy(F.desc("n"), "w", "digest").limit(most).select("w", "digest", "pieces").toArrow()
    common = spark.sparkContext.broadcast({w or d: p for w, d, p in zip(*(often[c].to_pylist() for c in ("w", "digest", "pieces")), strict=True)})  # at most ``most`` entries of 64 characters

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counter, pieces = worker_counter(path), common.value
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            done = 0
            for part in blocks(b.column(1).to_pylist()):
                n, rare = [], []
                for t in part:
                    freq, total = counter.frequencies(t)
                    left, here = [], {}
                    for w, c in freq.items():
                        if w in pieces:
                            total += c * pieces[w]
                        elif len(w) > LONGEST:
                            here[w] = c
                        elif len(w) > LONG and (d := md5(w.encode()).digest()) in pieces:
                            total += c * pieces[d]
                        else:
                            left.append((w, c))
                    if here:
                        total += sum(c * p for c, p in zip(here.values(), counter.piece_counts(list(here)), strict=True))
                    n.append(total)
                    rare.append(left)
                keys = b.column(0).slice(done, len(part))
                done += len(part)
                size = [len(t.encode()) for t in part]
                words = pa.array([[w for w, _ in x] for x in rare], pa.list_(pa.string()))
                times = pa.array([[c for _, c in x] for x in rare], pa.list_(pa.int32()))
                yield pa.record_batch([pa.array(range(row, row + len(part)), pa.int64()), keys, pa.array(size, pa.int64()), pa.array(n, pa.int64()), words, times], ["_row", key, "n_bytes", "_sum", "_w", "_c"])
                row += len(part)

    made = written(docs.select(key, text).mapInArrow(sums, f"_row long, `{key}` {kind}, n_bytes long, _sum long, _w array<string>, _c array<int>"), "frequencies")
    rare = made.where(F.size("_w") > 0).select("_row", F.explode(F.arrays_zip("_w", "_c")).alias("x")).select("_row", F.col("x._w").alias("w"), F.col("x._c").alias("c"))
    rest = rare.join(known.select("w", "pieces"), "w").groupBy("_row").agg(F.sum(F.col("c") * F.col("pieces")).alias("_rest"))
    total = (F.col("_sum") + F.coalesce("_rest", F.lit(0))).cast("long")
    out = made.select("_row", key, "n_bytes", "_sum").join(rest, "_row", "left")
    return out.select(key, "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
