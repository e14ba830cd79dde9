"""SentencePiece encoding and decoding (BPE models with byte fallback) by suffix-array matching.

A block of texts is cut into chunks inside which all merges stay (no piece holds the word mark after
another character, and none holds a character that no piece knows). The distinct chunks of the block
are concatenated and indexed by a suffix array, sorted as deep as the longest piece. Every piece is
found in it by binary search, which gives its range of occurrences; all occurrences, sorted by
position, are the edges (start, length) -> piece of the chunks' lattices. Relaxation then follows the
model's own order: in every chunk at once the best-scored edge that spans exactly two neighbouring
symbols is taken (the leftmost of equals), its inner boundary goes, and so on until no edge is left. A long
chunk (a text without blanks) takes its edges one by one from a heap instead, so its cost is its length
times the logarithm of that.
Ids equal those of the ``sentencepiece`` library; tests hold them against it.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spindrift.llm.common import table

MARK = "▁"
#: Characters of distinct chunks that one suffix array indexes, and texts read for it.
INDEXED, READ = 1 << 20, 1 << 20
#: Characters of known chunks after which the table of them starts afresh.
REMEMBERED = 1 << 24
#: Characters from which a chunk is relaxed by a heap instead of in rounds with the others.
LONG = 100


def read_model(path: str) -> tuple[list[tuple[str, float, int]], dict]:
    """Pieces (text, score, type) and the normaliser's switches."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    n = m.normalizer_spec
    switches = {"bpe": m.trainer_spec.model_type == 2, "fallback": m.trainer_spec.byte_fallback, "suffix": m.trainer_spec.treat_whitespace_as_suffix, "map": bool(n.precompiled_charsmap), "prefix": n.add_dummy_prefix, "squeeze": n.remove_extra_whitespaces, "escape": n.escape_whitespaces}
    return [(p.piece, p.score, p.type) for p in m.pieces], switches


class SuffixPieces:
    """Encoder and decoder for one model file; ``path`` must exist on every executor."""

    def __init__(self, path: str, known: int = 300_000):
        import regex

        pieces, has = read_model(path)
        normal = {i: (p, s) for i, (p, s, kind) in enumerate(pieces) if kind == 1}
        if not has["bpe"] or not has["fallback"] or has["suffix"] or has["map"] or has["squeeze"] or not has["escape"] or any(kind in (4, 5) for _, _, kind in pieces):
            raise ValueError("a BPE model with byte fallback and the identity normaliser is needed")
        if any(MARK in p.lstrip(MARK) for p, _ in normal.values()):
            raise ValueError("pieces must hold the word mark only in front")
        self.prefix = has["prefix"]
        self.byte_ids = np.zeros(256, np.int32)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == 6:
                self.byte_ids[int(p[1:-1], 16)] = i
        #: Decoded bytes of each id; control symbols give none, the unknown piece its surface.
        self.surface = [bytes([int(p[1:-1], 16)]) if kind == 6 else b"" if kind == 3 else " ⁇ ".encode() if kind == 2 else p.replace(MARK, " ").encode() for p, _, kind in pieces]
        alphabet = sorted({c for p, _ in normal.values() for c in p})
        self.code = np.zeros(0x110000, np.uint16)  # 0: in no piece
        self.code[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.single = np.full(len(alphabet) + 1, -1, np.int32)
        longer = []
        for i, (p, s) in normal.items():
            if len(p) == 1:
                self.single[self.code[ord(p)]] = i
            else:
                longer.append((p, s, i))
        self.depth = max(len(p) for p, _, _ in longer)
        self.text = np.zeros((len(longer), self.depth), np.uint16)
        for k, (p, _, _) in enumerate(longer):
            self.text[k, : len(p)] = self.code[[ord(c) for c in p]]
        self.length = np.array([len(p) for p, _, _ in longer])
        self.ids = np.array([i for _, _, i in longer], np.int32)
        # rank: position among the scores, best first; equal scores share one
        scores = np.array([s for _, s, _ in longer])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        # a newline is in no piece here: it is a chunk of its own, so that lines share chunks
        self.alone = "\n" not in alphabet
        self.cut = regex.compile(f"\\n|{MARK}*[^{MARK}\\n]+|{MARK}+" if self.alone else f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.most = known
        self.forget()

    def forget(self) -> None:
        """The known chunks: number of each, and where the ids of each number stand in one array."""
        self.known: dict[str, int] = {}
        self.chars = 0
        self.ends, self.known_ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    # -- the index ---------------------------------------------------------------------------
    def suffix_array(self, codes: np.ndarray) -> np.ndarray:
        """Order of all suffixes by their first ``depth`` codes, by doubling what one sort covers."""
        bits = max(1, len(self.single).bit_length())
        width = min(self.depth, 62 // bits)
        padded = np.concatenate([codes, np.zeros(width, codes.dtype)]).astype(np.int64)
        key = np.zeros(len(codes), np.int64)
        for d in range(width):
            key = (key << bits) | padded[d : d + len(codes)]
        order, rank = self.ranked(key)
        while width < self.depth:
            second = np.zeros_like(rank)
            second[:-width] = rank[width:] + 1
            order, rank = self.ranked(rank * (int(rank.max()) + 2) + second)
            width *= 2
        return order

    @staticmethod
    def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the keys and, for each, how many smaller keys there are."""
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        return order, rank

    def occurrences(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and row of every occurrence of every piece of two characters or more."""
        sa = self.suffix_array(codes)
        padded = np.concatenate([codes, np.zeros(self.depth, codes.dtype)])
        live = np.arange(len(self.length))
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(sa), np.int64)
        starts, rows = [], []
        for d in range(self.depth):
            want = self.text[live, d]
            ends = []
            for right in (False, True):  # first suffix with a code >= want, then > want
                a, b = lo.copy(), hi.copy()
                while (open_ := a < b).any():
                    mid = (a + b) >> 1
                    at = padded[sa[np.minimum(mid, len(sa) - 1)] + d]
                    less = (at <= want if right else at < want) & open_
                    a = np.where(less, mid + 1, a)
                    b = np.where(open_ & ~less, mid, b)
                ends.append(a)
            lo, hi = ends
            full = (self.length[live] == d + 1) & (hi > lo)
            if full.any():
                n = (hi - lo)[full]
                first = np.repeat(lo[full] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                starts.append(sa[first + np.arange(n.sum())])
                rows.append(np.repeat(live[full], n))
            go = (hi > lo) & (self.length[live] > d + 1)
            live, lo, hi = live[go], lo[go], hi[go]
            if not len(live):
                break
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(starts), np.concatenate(rows)

    # -- encoding ----------------------------------------------------------------------------
    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks one after another, and how many each has. Between chunks stands one code that no piece has."""
        text = "\0".join(chunks) + "\0"
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        codes = self.code[points].copy()
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ends = np.cumsum(sizes + 1) - 1
        codes[ends] = 0
        n = len(codes)
        start, row = self.occurrences(codes)
        # the edges, sorted by position and then length
        slot = start * (self.depth + 1) + self.length[row]
        order = np.argsort(slot)
        slot, row = slot[order], row[order]
        none = np.int64(1 << 40)

        def edge(at: np.ndarray, size: np.ndarray) -> np.ndarray:
            """Row of the piece that spans [at, at + size), or -1."""
            if not len(slot):
                return np.full(len(at), -1, np.int64)
            want = at * (self.depth + 1) + size
            k = np.minimum(np.searchsorted(slot, want), len(slot) - 1)
            return np.where((slot[k] == want) & (size <= self.depth), row[k], -1)

        piece = np.full(n, -1, np.int64)  # row of the piece of the symbol that starts here; -1: a single character
        alive = np.ones(n, bool)
        alive[ends] = False
        long = np.flatnonzero(sizes >= LONG)
        short = np.repeat(sizes < LONG, sizes + 1)
        if len(long):
            first = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(start, minlength=n))])
            for k in long.tolist():
                self.relax(slot, row, first, int(ends[k] - sizes[k]), int(ends[k]), piece, alive)
        chunk = np.repeat(np.arange(len(chunks)), np.where(sizes < LONG, sizes, 0))
        at = np.flatnonzero(short & alive)  # symbols still in play, with their chunk
        size = np.ones(len(at), np.int64)
        best = np.full(len(at), none)  # rank of the pair (symbol, next symbol)
        made = np.full(len(at), -1, np.int64)
        pair = np.flatnonzero(chunk[1:] == chunk[:-1])
        made[pair] = edge(at[pair], size[pair] + size[pair + 1])
        best[pair] = np.where(made[pair] >= 0, self.rank[made[pair]], none)
        while len(at):
            first = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
            least = np.minimum.reduceat(best, first)
            counts = np.diff(np.append(first, len(at)))
            busy = least < none
            if not busy.all():  # chunks without a pair are done
                stay = np.repeat(busy, counts)
                at, chunk, size, best, made = at[stay], chunk[stay], size[stay], best[stay], made[stay]
                if not len(at):
                    break
                first = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
                counts = np.diff(np.append(first, len(at)))
                least = least[busy]
            hit = np.flatnonzero(best == np.repeat(least, counts))
            hit = hit[np.concatenate([[True], chunk[hit][1:] != chunk[hit][:-1]])]  # the leftmost
            piece[at[hit]] = made[hit]
            alive[at[hit + 1]] = False
            size[hit] += size[hit + 1]
            keep = np.ones(len(at), bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            at, chunk, size, best, made = at[keep], chunk[keep], size[keep], best[keep], made[keep]
            hit = moved[hit]
            again = np.concatenate([hit, hit - 1])
            again = again[again >= 0]
            again_next = np.minimum(again + 1, len(at) - 1)
            same = (again + 1 < len(at)) & (chunk[again_next] == chunk[again])
            best[again], made[again] = none, -1
            again, again_next = again[same], again_next[same]
            made[again] = edge(at[again], size[again] + size[again_next])
            best[again] = np.where(made[again] >= 0, self.rank[made[again]], none)
        # symbols to ids; characters without a piece become their UTF-8 bytes
        at = np.flatnonzero(alive)
        chunk = np.searchsorted(ends, at)
        ids = np.where(piece[at] >= 0, self.ids[piece[at]], self.single[codes[at]])
        lost = np.flatnonzero(ids < 0)
        if len(lost):
            raw = [chr(points[i]).encode() for i in at[lost]]
            n_ids = np.ones(len(at), np.int64)
            n_ids[lost] = list(map(len, raw))
            firsts = np.concatenate([[0], np.cumsum(n_ids)[:-1]])
            out = np.empty(n_ids.sum(), np.int32)
            out[firsts[ids >= 0]] = ids[ids >= 0]
            where = np.repeat(firsts[lost], n_ids[lost]) + np.concatenate([np.arange(len(r)) for r in raw])
            out[where] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            ids, chunk = out, np.repeat(chunk, n_ids)
        return ids.astype(np.int32), np.bincount(chunk, minlength=len(chunks))

    def relax(self, slot: np.ndarray, row: np.ndarray, first: np.ndarray, begin: int, end: int, piece: np.ndarray, alive: np.ndarray) -> None:
        """Take the edges of one chunk [begin, end) best first, the leftmost of equals; marks ``piece`` and
        ``alive``. ``first`` says where the edges of each position begin in ``slot`` and ``row``."""
        lo, hi = int(first[begin]), int(first[end])
        width = self.depth + 1
        rows = row[lo:hi]
        size = array("i", (slot[lo:hi] % width).astype(np.int32).tobytes())
        rank, rows = array("q", self.rank[rows].tobytes()), array("q", rows.astype(np.int64).tobytes())
        at = array("q", (first[begin : end + 1] - lo).tobytes())
        n = end - begin
        length = array("i", [1]) * n  # of the symbol that starts here, 0 inside one
        before = array("i", range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []  # rank, start, size of the span, edge

        def offer(a: int) -> tuple[int, int, int, int] | None:
            b = a + length[a]
            if b >= n:
                return None
            want = length[a] + length[b]
            for e in range(at[a], at[a + 1]):
                if size[e] >= want:
                    return (rank[e], a, want, e) if size[e] == want else None
            return None

        heap = [x for x in map(offer, range(n)) if x]
        heapify(heap)
        made = {}
        while heap:
            _, a, want, e = heappop(heap)
            if not length[a] or (b := a + length[a]) >= n or length[a] + length[b] != want:
                continue  # one of the two symbols is no more
            length[a], length[b] = want, 0
            made[a] = e
            if (c := a + want) < n:
                before[c] = a
            if x := offer(a):
                heappush(heap, x)
            if (p := before[a]) >= 0 and (x := offer(p)):
                heappush(heap, x)
        alive[begin:end] = np.frombuffer(length, np.int32) > 0
        for a, e in made.items():
            piece[begin + a] = rows[e]

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        return self.cut((MARK if self.prefix else "") + text.replace(" ", MARK))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text begins (one more than texts)."""
        if len(self.known) > self.most or self.chars > REMEMBERED:
            self.forget()
        known, cut = self.known, [self.chunks(t) for t in texts]
        flat = list(chain.from_iterable(cut))
        new = list(set(flat).difference(known))
        self.chars += sum(map(len, new))
        part, chars, made, sizes = [], 0, [self.known_ids], []
        for i, c in enumerate(new):
            part.append(c)
            chars += len(c) + 1
            if chars >= INDEXED or i == len(new) - 1:
                ids, n = self.encode_chunks(part)
                made.append(ids)
                sizes.append(n)
                known.update(zip(part, range(len(known), len(known) + len(part)), strict=True))
                part, chars = [], 0
        if sizes:
            self.known_ids = np.concatenate(made)
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes))])
        number = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        n = self.ends[number + 1] - self.ends[number]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(self.ends[number] - ends[:-1], n) + np.arange(ends[-1])
        return self.known_ids[at], ends[np.concatenate([[0], np.cumsum(np.array([len(one) for one in cut], np.int64))])].astype(np.int64)

    def decode(self, ids: list[int]) -> str:
        """Text of a list of ids; the mark that encoding puts in front goes."""
        s = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return s[1:] if self.prefix and s[:1] == " " else s


_MODELS: dict[str, SuffixPieces] = {}


def worker_model(path: str) -> SuffixPieces:
    """One model in each Python worker: its table of known chunks outlives a task."""
    if path not in _MODELS:
        _MODELS[path] = SuffixPieces(path)
    return _MODELS[path]


def _texts(texts: list[str | None]) -> Iterator[list[str]]:
    from spindrift.llm.tokencount import blocks

    return blocks(texts, READ)


def encode_texts(docs: DataFrame, path: str, text: str = "text", check: bool = True) -> DataFrame:
    """Adds ``ids`` (array of int), ``n_ids`` and, with ``check``, ``round_trip`` to every row: whether
    decoding the ids gives the text back (a text that itself holds the word mark does not).

    Null and empty texts have no ids and come back as the empty text; repeated rows have their ids each; an
    empty table stays empty. A text of any length is encoded whole, without blanks too. Columns of the new
    names are replaced; all others are carried.
    """
    docs = docs.drop("ids", "n_ids", "round_trip")
    at = docs.columns.index(text)
    added = "ids array<int>, n_ids long" + ", round_trip boolean" * check

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_model(path)
        for b in batches:
            done = 0
            for part in _texts(b.column(at).to_pylist()):
                ids, ends = model.encode(part)
                own = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), pa.array(np.diff(ends))]
                if check:
                    flat, e = ids.tolist(), ends.tolist()
                    own.append(pa.array([model.decode(flat[x:y]) == t for x, y, t in zip(e[:-1], e[1:], part, strict=True)], pa.bool_()))
                rows = b.slice(done, len(part))
                done += len(part)
                yield pa.record_batch([*rows.columns, *own], [*b.schema.names, "ids", "n_ids", *["round_trip"] * check])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, {added}")


def decode_ids(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Replaces or adds ``text``: the ids decoded; null ids give null."""
    df = df.drop(text)
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_model(path)
        for b in batches:
            yield pa.record_batch([*b.columns, pa.array([None if x is None else model.decode(x) for x in b.column(at).to_pylist()], pa.string())], [*b.schema.names, text])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{text}` string")


def op5_sentencepiece_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")
