"""Benchmark decontamination by the q-gram lemma in diagonal bands.

An item of n characters found with at most e edits shares at least n - q + 1 - q * e of its q-grams with
the place, and their diagonals (place minus offset in the item) lie within e of each other. Texts are
read in blocks: positions whose q-gram some item has are marked, stretches too thin to hold any item's
share are left at once, and in the rest the shared q-grams are counted in bands of diagonals that
overlap by half. Bands that reach the item's bound are verified by an alignment confined to the band.
Long items are counted by pieces: of p pieces one holds at most e / p of the edits, so it alone must share
its part of q-grams in a narrow band, which repetitive text seldom does by chance.
All of it is exact: filters drop only what the lemma excludes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spindrift.llm.common import table, written

Q = 8
#: Edits that a match may hold, as a share of the item's characters.
EDIT_SHARE = 0.08
#: Characters of benchmark items searched for in one pass over the documents.
ITEM_BLOCK = 4 << 20
#: Pairs of equal q-grams made at once; places of a q-gram in one item above which they are one stretch; more
#: bands than the longest text has; diagonals that are aligned together at most.
PAIRS, OFTEN, BANDS, WIDE = 1 << 20, 4, 1 << 36, 4096
#: Characters that a piece of an item has at least, and less than twice as many.
PIECE = 256


def normalised(text: str | None) -> str:
    """Lower case, white space runs as one blank, none at the ends."""
    return " ".join((text or "").lower().split())


def original_span(text: str, start: int, stop: int) -> tuple[int, int]:
    """Where characters [start, stop) of the normalised text stand in the text itself."""
    at, found, gap, begun = 0, [0, len(text)], False, False
    for i, c in enumerate(text):
        if c.isspace():
            gap = begun
            continue
        if gap:
            at += 1
            gap = False
        begun = True
        if at <= start:
            found[0] = i
        at += len(c.lower())
        if at >= stop:
            found[1] = i + 1
            break
    return found[0], found[1]


def budget(n: int, share: float = EDIT_SHARE, q: int = Q) -> int:
    """Edits allowed to an item of n characters; fewer where the lemma would ask for no q-gram at all."""
    return max(0, min(int(n * share), (n - q) // q))


def pieces(n: int, edits: int, q: int = Q, least: int = PIECE) -> list[tuple[int, int, int]]:
    """(start, size, edits) of the pieces of an item: in a match one of them has no more edits than that. There
    are fewer where a piece's bound would ask for no q-gram."""
    p = max(1, n // least)
    while p > 1 and n // p - q + 1 - q * (edits // p) < 1:
        p -= 1
    cuts = [n * k // p for k in range(p + 1)]
    return [(a, b - a, edits // p) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def aligned(item: np.ndarray, place: np.ndarray, low: int, high: int, most: int, free: bool) -> tuple[int, int] | None:
    """Fewest edits of the item against a stretch of the place, and the stretch's end, on diagonals low to
    high only; None above ``most``. ``free``: the stretch may begin anywhere, else at 0."""
    far = 1 << 20
    k = np.arange(low, high + 1)
    row = np.where((k >= 0) & (k <= len(place)), 0 if free else np.abs(k), far)
    for i, c in enumerate(item, 1):
        j = k + i  # end of the stretch after i characters of the item
        inside = (j >= 1) & (j <= len(place))
        same = np.zeros(len(k), bool)
        same[inside] = place[j[inside] - 1] == c
        new = row + ~same
        new[~inside] = far
        skipped = np.append(row[1:], far) + 1  # the item's character is missing in the place
        skipped[(j < 0) | (j > len(place))] = far
        new = np.minimum(new, skipped)
        new = np.minimum.accumulate(new - k) + k  # extra characters in the place
        new[(j < 0) | (j > len(place))] = far
        row = new
        if row.min() > most:
            return None
    best = int(row.argmin())
    return (int(row[best]), int(best + low + len(item))) if row[best] <= most else None


def slices(known: np.ndarray, code: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (place in ``code``, place in the sorted ``known``) of equal numbers, in slices of about ``most``."""
    lo, hi = np.searchsorted(known, code, "left"), np.searchsorted(known, code, "right")
    ends = np.cumsum(hi - lo)
    begin = 0
    while begin < len(code):
        done = int(ends[begin - 1]) if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, done + most, "right")))
        n = (hi - lo)[begin:stop]
        if total := int(n.sum()):
            here = np.repeat(np.arange(begin, stop), n)
            yield here, np.repeat(lo[begin:stop] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
        begin = stop


class Table:
    """Sums by key, merged whenever what is new outgrows what is held."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = self.new = 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.parts.append(self.summed(keys, n))
        self.new += len(self.parts[-1][0])
        if self.new > max(self.held, PAIRS):
            self.done()

    @staticmethod
    def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.add.reduceat(n[order], first) if len(first) else n

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.parts = [self.summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
        self.held, self.new = len(self.parts[0][0]), 0
        return self.parts[0]


class Items:
    """One block of benchmark items, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str]], share: float = EDIT_SHARE, q: int = Q, piece: int = PIECE):
        self.q = q
        known = [(i, s, budget(len(s), share, q)) for i, s in items if s]
        self.short = [(i, s) for i, s, _ in known if len(s) < q]
        self.items = [x for x in known if len(x[1]) >= q]
        if not self.items:
            return
        # what is counted is pieces: which item, where in it, and the piece's own size, edits and bound
        known = [(k, *x) for k, (_, s, e) in enumerate(self.items) for x in pieces(len(s), e, q, piece)]
        self.of, self.start, sizes, self.edits = (np.array(x) for x in zip(*known, strict=True))
        self.bound = sizes - q + 1 - q * self.edits
        self.sizes = sizes
        codes = [self.grams(self.folded(self.items[k][1][a : a + n])) for k, a, n, _ in known]
        code = np.concatenate(codes)
        item = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        offset = np.concatenate([np.arange(len(c)) for c in codes])
        order = np.lexsort((offset, item, code))
        code, item, offset = code[order], item[order], offset[order]
        self.bits = max(16, (len(code) * 16 - 1).bit_length())
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self.slot(code)] = True
        # q-grams that an item holds often (runs of one character) are kept as their first and last place
        start = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (item[1:] != item[:-1])]))
        n = np.diff(np.append(start, len(code)))
        often = start[n > OFTEN]
        self.often, self.often_item, self.often_first, self.often_last = code[often], item[often], offset[often], offset[often + n[n > OFTEN] - 1]
        few = np.repeat(n <= OFTEN, n)
        self.code, self.item, self.offset = code[few], item[few], offset[few]
        # every match holds, at some piece, a stretch of this many positions with this many marked ones
        self.stretch = int((sizes + self.edits).min())
        self.least = int(min(-(-b // -(-(n + e) // self.stretch)) for b, n, e in zip(self.bound, sizes, self.edits, strict=True)))
        self.text = [np.frombuffer(s.encode("utf-32-le"), np.uint32) for _, s, _ in self.items]

    def folded(self, s: str) -> np.ndarray:
        """One byte a character; different characters may share one, which only adds candidates."""
        points = np.frombuffer(s.encode("utf-32-le"), np.uint32)
        return (points ^ (points >> 8)).astype(np.uint8)

    def grams(self, folded: np.ndarray) -> np.ndarray:
        """The q bytes from each position as one number (q is 8)."""
        n = len(folded) - self.q + 1
        return np.ndarray(n, "<u8", np.ascontiguousarray(folded), 0, (1,)).copy() if n > 0 else np.zeros(0, np.uint64)

    def slot(self, code: np.ndarray) -> np.ndarray:
        return (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def candidates(self, text: str) -> list[tuple[int, int, int]]:
        """(item, first diagonal, last diagonal) of bands where a piece of the item reaches its bound, in a text
        that may hold many documents. Pairs of text and piece positions are made in slices of ``PAIRS``."""
        code = self.grams(self.folded(text))
        marked = self.table[self.slot(code)]
        count = np.concatenate([[0], np.cumsum(marked)])
        width = min(self.stretch, len(marked))
        dense = np.flatnonzero(count[width:] - count[:-width] >= min(self.least, width)) if width else []
        if not len(dense):
            return []
        # positions of the dense stretches, with room for the longest match around them
        room = int((self.sizes + self.edits).max())
        edge = np.zeros(len(marked) + 1, np.int64)
        np.add.at(edge, np.maximum(dense - room, 0), 1)
        np.add.at(edge, np.minimum(dense + width + room, len(marked)), -1)
        at = np.flatnonzero(marked & (np.cumsum(edge[:-1]) > 0))
        shift = room + int(self.edits.max()) + 1  # so that no band is below 1
        table = Table()
        for here, row in slices(self.code, code[at], PAIRS):
            item = self.item[row]
            key = item * BANDS + (at[here] - self.offset[row] + shift) // (self.edits[item] + 1)
            table.add(np.concatenate([key, key - 1]), np.ones(2 * len(key), np.int64))
        keys, counts = table.done()
        found = []
        for k, (first, last, n) in self.spans(code[at], at, shift).items():
            lo, hi = np.searchsorted(keys, [k * BANDS, (k + 1) * BANDS])
            band = keys[lo:hi] - k * BANDS
            where = np.searchsorted(first, band, "right") - 1
            inside = (where >= 0) & (band <= last[np.maximum(where, 0)])
            counts[lo:hi] += np.where(inside, n[np.maximum(where, 0)], 0)
            enough = n >= self.bound[k]
            lengths = (last - first + 1)[enough]
            found.append(k * BANDS + np.repeat(first[enough] - np.concatenate([[0], np.cumsum(lengths)])[:-1], lengths) + np.arange(lengths.sum()))
        good = np.unique(np.concatenate([keys[counts >= self.bound[keys // BANDS]], *found]))
        # neighbouring bands of an item, from whichever piece, are verified together
        piece, band = good // BANDS, good % BANDS
        step, at_item = self.edits[piece] + 1, self.start[piece] + shift
        out: list[tuple[int, int, int]] = []
        for i, a, b in sorted(zip(self.of[piece].tolist(), (band * step - at_item).tolist(), ((band + 2) * step - at_item - 1).tolist(), strict=True)):
            if out and out[-1][0] == i and a <= out[-1][2] + self.items[i][2] + 1 and b - out[-1][1] <= WIDE:
                out[-1] = (i, out[-1][1], max(b, out[-1][2]))
            else:
                out.append((i, a, b))
        return out

    def spans(self, code: np.ndarray, at: np.ndarray, shift: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each piece with repeated q-grams that the text has: bands (first, last) and how many positions
        may share such a q-gram there. A position counts in every band between those of the q-gram's first
        and last place in the item, which is never too little and takes no pair for each place."""
        changes: dict[int, Table] = {}
        for here, row in slices(self.often, code, PAIRS):
            order = np.argsort(self.often_item[row], kind="stable")
            here, row = here[order], row[order]
            item = self.often_item[row]
            cuts = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1], [True]]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                k, p = int(item[a]), at[here[a:b]] + shift
                step = int(self.edits[k]) + 1
                first, last = (p - self.often_last[row[a:b]]) // step - 1, (p - self.often_first[row[a:b]]) // step
                changes.setdefault(k, Table()).add(np.concatenate([first, last + 1]), np.repeat([1, -1], b - a))
        out = {}
        for k, table in changes.items():
            band, change = table.done()
            out[k] = (band[:-1], band[1:] - 1, np.cumsum(change)[:-1])
        return out

    def verified(self, text: str, item: int, first: int, last: int) -> tuple[int, int, int] | None:
        """(edits, start, stop) of the best match of an item that begins near these diagonals; None also where
        a whole item has no room: the text begins with the item's tail or ends with its head."""
        _, s, most = self.items[item]
        first, last = max(first, -most), min(last, len(text) - len(s) + 2 * most)
        if first > last:
            return None
        begin = max(0, first - most)
        part = text[begin : last + len(s) + most + 1]
        if (at := part.find(s)) >= 0:
            return 0, begin + at, begin + at + len(s)
        place = np.frombuffer(part.encode("utf-32-le"), np.uint32)
        if (found := aligned(self.text[item], place, first - most - begin, last + most - begin, most, True)) is None:
            return None
        edits, stop = found
        back = aligned(self.text[item][::-1], place[:stop][::-1], -most, most, most, False)
        return edits, begin + stop - (back[1] if back else len(s)), begin + stop

    def search(self, texts: list[str]) -> list[dict[int, tuple[int, int, int]]]:
        """For each normalised text its items with (edits, start, stop) of the best match, the first of equals."""
        out: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        for i, s in self.short:
            for k, t in enumerate(texts):
                if (at := t.find(s)) >= 0:
                    out[k][i] = (0, at, at + len(s))
        if not self.items:
            return out
        ends = np.cumsum([len(t) + 1 for t in texts])
        for item, first, last in self.candidates("\0".join(texts) + "\0"):
            # a band may touch two texts: each is tried by itself
            here = int(np.searchsorted(ends, max(0, first), "right"))
            stop = int(np.searchsorted(ends, max(0, last), "right"))
            for k in range(here, min(stop, len(texts) - 1) + 1):
                base = int(ends[k]) - len(texts[k]) - 1
                if found := self.verified(texts[k], item, first - base, last - base):
                    i = self.items[item][0]
                    out[k][i] = min(out[k].get(i, found), found)
        return out


def item_blocks(benchmark: DataFrame, key: str, text: str, most: int = ITEM_BLOCK) -> Iterator[list[tuple[int, str]]]:
    """Normalised items in blocks of at most about ``most`` characters; the driver holds one at a time."""
    part, chars = [], 0
    for i, t in benchmark.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).toLocalIterator():
        part.append((i, normalised(t)))
        chars += len(part[-1][1])
        if chars >= most:
            yield part
            part, chars = [], 0
    if part:
        yield part


_HELD: dict[str, Items] = {}


def worker_items(name: str, block: list[tuple[int, str]], share: float) -> Items:
    """The items of a block, made once in each Python worker, which holds one block at a time."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = Items(block, share)
    return _HELD[name]


def find_items(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", share: float = EDIT_SHARE, most: int = ITEM_BLOCK) -> DataFrame:
    """One row for each document and benchmark item found in it: keys, ``edits`` and the span ``start`` to
    ``stop`` (code points of the text) of the best match, the first of equals.

    Case and runs of white space do not count. Null texts and items match nothing, nor do empty ones;
    items too short for a q-gram must stand as they are. Equal items are each found. Repeated rows of
    documents each give their rows. Other columns are not carried. Texts of any length are searched whole;
    a q-gram that an item holds often takes no more than its first and last place. Items beyond ``most``
    characters are searched for in further passes, each written before the next one's items are gathered.
    """
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
    schema = f"`{key}` {kind}, `{item_key}` {item_kind}, edits int, start long, stop long"
    item_type = to_arrow_type(benchmark.schema[item_key].dataType)
    out, found = None, None
    for block in item_blocks(benchmark, item_key, item_text, most):
        if found is not None:
            found = written(found, "found")
            out = found if out is None else out.unionByName(found)
        name, items = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(block)  # at most about ``most`` characters

        def run(batches: Iterator[pa.RecordBatch], name: str = name, items=items) -> Iterator[pa.RecordBatch]:
            from spindrift.llm.tokencount import blocks

            known = worker_items(name, items.value, share)
            for b in batches:
                keys, done = b.column(0), 0
                for part in blocks(b.column(1).to_pylist()):
                    rows = [(done + k, i, *x) for k, found in enumerate(known.search([normalised(t) for t in part])) for i, x in sorted(found.items())]
                    if rows:
                        spans = [original_span(part[r[0] - done], r[3], r[4]) for r in rows]
                        columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), item_type, pa.int32()))]
                        places = [pa.array(x, pa.int64()) for x in zip(*spans)]
                        yield pa.record_batch([keys.take(columns[0]), *columns[1:], *places], [key, item_key, "edits", "start", "stop"])
                    done += len(part)

        found = docs.select(key, text).mapInArrow(run, schema)
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    return found if out is None else out.unionByName(found)


def without_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", share: float = EDIT_SHARE, most: int = ITEM_BLOCK) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no benchmark item is found. Each row is judged where
    it is read, so nothing is joined or shuffled. Nulls, empty texts and items: as in :func:`find_items`."""
    at = docs.columns.index(text)
    for n, block in enumerate(item_blocks(benchmark, item_key, item_text, most)):
        if n:
            docs = written(docs, "clean")
        name, items = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(block)  # at most about ``most`` characters

        def run(batches: Iterator[pa.RecordBatch], name: str = name, items=items) -> Iterator[pa.RecordBatch]:
            from spindrift.llm.tokencount import blocks

            known = worker_items(name, items.value, share)
            for b in batches:
                clean = [not found for part in blocks(b.column(at).to_pylist()) for found in known.search([normalised(t) for t in part])]
                yield b.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op10_decontamination_qgram_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
