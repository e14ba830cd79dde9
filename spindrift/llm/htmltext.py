"""Main text of web pages, with a suffix array over each host's pages.

A page becomes a list of blocks, each with what its markup says: article, doubtful (inside an article, but
named like furniture), main, furniture (menus, footers, forms ...), or nothing. Text inside an article is
protected: a passage quoted on several pages belongs to each of them. All other words of a host's pages are
concatenated, a page and each gap that an article leaves apart by a mark of its own, and sorted as a suffix
array to ``repeat`` words; windows that stand in two or more different pages cover boilerplate, and covered
runs go word by word: from doubtful blocks of pages with an article, else from the main part, else from all
that is no furniture.

Every page is parsed once and goes through its host's suffix array, articles too. A hot host is dealt into buckets, one suffix array each. Which windows
two of its buckets share is found before by window hashes, so buckets bound a task's memory and not the
results.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import octets, table, written
from spindrift.llm.urlfilter import url_parts

#: Words in a repeated run, characters of one host that one suffix array holds.
REPEAT, BUCKET = 8, 8 << 20
#: Window hashes of hot hosts that a task gathers before it hands them on.
GATHERED = 1 << 20

# Element names and class words.
RAW = "script|style|noscript|template|svg|iframe|object|canvas|textarea|select|annotation-xml|annotation"
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Elements of formulas, which stand in the line.
INLINE |= set("math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mstyle mspace mpadded mphantom mtable mtr mtd semantics".split())
CONTAINERS = set("html body div section article main nav header footer aside form ul ol dl table tbody thead tfoot tr td th blockquote fieldset figure details dialog menu center".split())
FURNITURE = set("nav footer aside form button dialog menu head title".split())
FURNITURE_WORDS = set("ad ads advert adverts advertisement advertisements advertising banner banners cookie cookies consent gdpr notice notices sidebar sidebars menu menus nav navbar navigation footer masthead comment comments respond disqus share sharing social related recommended promo promos promotion sponsor sponsored popup modal overlay newsletter subscribe signup login breadcrumb breadcrumbs pagination pager toolbar widget widgets alert".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())

#: Whole class names and ids of what is no part of an article it stands in.
NOT_ARTICLE = set("ad ads advert advertisement comments comment-list respond sidebar newsletter".split())
#: First words of compound class names and ids of the same kind, such as ``comment-thread`` and ``cookie_banner``.
NOT_ARTICLE_FIRST = re.compile(r"(?:comments?|cookies?|consent|disqus)[-_]")

_TAG = re.compile(
    rf"""
    <!--(?:.*?-->|.*\Z)
    | <(?P<raw>{RAW})\b(?>[^>"']|"[^"]*"|'[^']*')*+(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)
    | <(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?>[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)
    | <(?P<end2>/?)(?P<name2>[a-z][^\s/>]*)[^>]*(?:>|\Z)
    | <[!?/][^>]*(?:>|\Z)
    """,
    re.S | re.I | re.X,
)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")

OTHER, MAIN, ARTICLE, FURNISHED, DOUBT = 0, 1, 2, 3, 4
Block = tuple[str, int]


class _Open:
    """The open elements, with where each name and the containers stand, so that no step walks the stack."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}
        self.containers: list[int] = []

    def push(self, name: str, state: int) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        if name in CONTAINERS:
            self.containers.append(len(self.stack))
        self.stack.append((name, state))

    def last(self, name: str) -> int:
        """Where the innermost element of a name stands if no container stands inside it, else -1."""
        at = self.places.get(name)
        if not at or (self.containers and self.containers[-1] > at[-1]):
            return -1
        return at[-1]

    def innermost(self, name: str) -> int:
        at = self.places.get(name)
        return at[-1] if at else -1

    def cut(self, at: int) -> int:
        """Close everything from a place on; gives the state that is left."""
        while len(self.stack) > at:
            name, _ = self.stack.pop()
            self.places[name].pop()
            if name in CONTAINERS:
                self.containers.pop()
        return self.stack[-1][1] if self.stack else OTHER


def _state(name: str, attrs: str, state: int) -> int:
    """State inside an element from its name, class, id and role. Inside an article or the main part only
    whole names count; words in names (``share-price``, ``menu-of-the-day``) leave an article's part in doubt."""
    words, names, role = set(), set(), ""
    for key, value in _ATTR.findall(attrs) if attrs else ():
        value = value.strip("\"' ").lower()
        if key.lower() == "role":
            role = value
        else:
            names.update(value.split())
            words.update(_WORD.findall(value))
    if name in ("article", "main", "body", "html"):
        if name in ("article", "main") and names & {"comment", "comments", "ad", "advert", "sponsored", "related", "promo"}:
            return FURNISHED
    elif name in FURNITURE or role in FURNITURE_ROLES or names & NOT_ARTICLE or any(map(NOT_ARTICLE_FIRST.match, names)):
        return FURNISHED
    elif state == OTHER and (words & FURNITURE_WORDS or name == "header" or "header" in words):
        return FURNISHED
    elif state == ARTICLE and words & FURNITURE_WORDS:
        return DOUBT
    if state != DOUBT and (name == "article" or role == "article"):
        return ARTICLE
    if state == OTHER and (name == "main" or role == "main"):
        return MAIN
    return state


def page_blocks(page: str) -> list[Block]:
    """Visible blocks of a page in order: text, and what the markup says of it. Linear in the page."""
    out: list[Block] = []
    pieces: list[str] = []
    opened = _Open()
    state = OTHER

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                out.append((text, state))

    def close(at: int) -> None:
        nonlocal state
        if (new := opened.cut(at)) != state:
            flush()
            state = new

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            pieces.append(page[at : m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            continue
        name = name.lower()
        if name in VOID:
            if name == "br":
                pieces.append(" ")
            elif name == "hr":
                flush()
            continue
        inline = name in INLINE
        if m["end"] or m["end2"]:
            # an end tag closes its element if that is open, and not one outside the container it stands in
            if not inline:
                flush()
            place = opened.innermost(name) if name in CONTAINERS else opened.last(name)
            if place >= 0:
                close(place)
            continue
        if not inline:
            flush()
            # a block ends an open paragraph, an item the one before it
            place = opened.last("p")
            if name in ("li", "dt", "dd", "option"):
                place = max(place, opened.last(name))
            if place >= 0:
                close(place)
        new = state if state == FURNISHED else _state(name, m["attrs"], state)
        if new != state:
            flush()
            state = new
        opened.push(name, state)
    if at < len(page):
        pieces.append(page[at:])
    flush()
    return out


def page_name(blocks: list[Block]) -> int:
    """Signed 64 bits of all words: pages with the same words count as one page."""
    return _hash(" ".join(t for t, _ in blocks)) - (1 << 63)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def window_hashes(words: list[str], known: dict[str, int], repeat: int = REPEAT) -> np.ndarray:
    """64-bit hashes of the windows of ``repeat`` words, in order. ``known`` keeps hashes of words."""
    n = max(0, len(words) - repeat + 1)
    h = np.array([known[w] if w in known else known.setdefault(w, _hash(w)) for w in words], np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(repeat if n else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return out


def covered_words(pages: list[list[list[str] | None]], names: list[int], repeat: int = REPEAT, shared: np.ndarray | None = None) -> list[list[np.ndarray | None]]:
    """For each page and block of words, which of them lie in runs that another page of the group holds too.

    A block that is None is a gap that no run crosses. Pages with the same name count as one page.
    ``shared`` are hashes of windows that the pages share with pages beyond the group.
    """
    ids: dict[str, int] = {}
    owner: dict[int, int] = {}
    flat: list[int] = []
    home, begin, segments = [], [], []  # page of each token, where each page's blocks begin, stretches without a gap
    for page, name in zip(pages, names, strict=True):
        at, first, begins, words = len(flat), len(flat), [], []
        for block in page:
            begins.append(len(flat))
            if block is None:
                segments.append((first, words))
                words = []
                flat.append(0)
                first = len(flat)
            else:
                flat.extend(ids.setdefault(w, len(ids) + 1) for w in block)
                words.extend(block)
        segments.append((first, words))
        flat.append(0)
        begin.append(begins)
        home.append(np.full(len(flat) - at, owner.setdefault(name, len(owner)), np.int64))
    text = np.array(flat, np.int64)
    n = len(text)
    if not ids:
        return [[None if block is None else np.zeros(0, bool) for block in page] for page in pages]
    gaps = np.flatnonzero(text == 0)
    text[gaps] = len(ids) + 1 + np.arange(len(gaps))  # a mark of its own for each
    order, rank = suffix_array(text, repeat)
    ordered = rank[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    of = np.concatenate(home)[order]
    twice = np.minimum.reduceat(of, starts) != np.maximum.reduceat(of, starts)
    hit = np.zeros(n, bool)
    hit[order] = np.repeat(twice, np.diff(np.append(starts, n)))
    if shared is not None:
        known: dict[str, int] = {}
        for first, words in segments:
            h = window_hashes(words, known, repeat)
            if len(h):
                hit[first : first + len(h)] |= np.isin(h, shared)
    edge = np.zeros(n + repeat + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + repeat, -1)
    covered = np.cumsum(edge[:n]) > 0
    return [[None if block is None else covered[k : k + len(block)] for block, k in zip(page, begins, strict=True)] for page, begins in zip(pages, begin, strict=True)]


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes by their first ``depth`` numbers, and the rank of each: equal where those are."""
    n, rank, width = len(text), text, 1
    order = np.argsort(rank, kind="stable")
    while width < depth:
        second = np.full(n, -1, np.int64)
        step = min(width, depth - width)
        second[:-step] = rank[step:]
        key = rank * (int(rank.max()) + 2) + second + 1
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        width += step
    return order, rank


def unique_words(words: list[str], covered: np.ndarray, repeat: int = REPEAT) -> list[str]:
    """A block without its covered runs. A run goes if ``repeat`` of its words stand in the block, or if it is
    the whole block; fewer words at an edge that a run of the next block reaches over stay."""
    if covered.all():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    kept, at = [], 0
    for a, b in edges.reshape(-1, 2).tolist():
        if b - a >= repeat:
            kept += words[at:a]
            at = b
    return kept + words[at:]


def stream(blocks: list[Block]) -> list[list[str] | None]:
    """The words that the index sees: a gap for each protected block."""
    return [None if s == ARTICLE else t.split(" ") for t, s in blocks]


def main_texts(pages: list[list[Block]], names: list[int], repeat: int = REPEAT, shared: np.ndarray | None = None) -> list[tuple[str, int]]:
    """Text of each page of one host, and the words that runs took from it. ``shared``: see
    :func:`covered_words`."""
    words = [stream(page) for page in pages]
    covered = covered_words(words, names, repeat, shared)
    out = []
    for page, own, hits in zip(pages, words, covered, strict=True):
        states = {s for _, s in page}
        wanted = (ARTICLE, DOUBT) if states & {ARTICLE, DOUBT} else (MAIN,) if MAIN in states else (OTHER,)
        keep, gone = [], 0
        for (t, s), w, c in zip(page, own, hits, strict=True):
            if s in wanted:
                left = [t] if w is None else unique_words(w, c, repeat)
                gone += 0 if w is None else len(w) - len(left)
                keep.append(" ".join(left))
        out.append(("\n".join(t for t in keep if t), gone))
    return out


def _packed(w: np.ndarray) -> bytes:
    """Sorted windows as steps, bytes of one rank together, so that the shuffle's compression finds empty ones."""
    return np.diff(w, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(steps.T).view(np.uint64).ravel(), dtype=np.uint64)


def shared_windows(streams: DataFrame) -> DataFrame:
    """``_host, _b, _w``: packed hashes of the windows of a bucket that another bucket of its host holds too.
    Takes ``_blocks`` and ``_host``, its bucket ``_b`` and number of buckets ``_n``.

    A host's windows are dealt by their hash into as many parts as it has buckets; a window goes to its part
    once for each bucket and round, so no part grows with how often it stands. Pages with the same words lie
    in one bucket, so two buckets are two pages.
    """
    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        known: dict[str, int] = {}

        def done() -> pa.RecordBatch:
            rows = []
            for (host, b, n), found in held.items():
                w = np.unique(np.concatenate(found))
                part = (w >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
                rows += [(host, k, b, _packed(w[part == k])) for k in np.unique(part).tolist()]
            held.clear()
            known.clear()
            return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["_host", "_part", "_b", "_w"])

        total = 0
        for batch in batches:
            for data, host, b, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts, words = [], []
                for block in [*stream(_loaded(data)), None]:
                    if block is None:
                        parts.append(window_hashes(words, known))
                        words = []
                    else:
                        words.extend(block)
                held.setdefault((host, b, n), []).append(np.unique(np.concatenate(parts)))
                total += len(held[host, b, n][-1])
                if total >= GATHERED:
                    yield done()
                    total = 0
        if held:
            yield done()

    def join(key: tuple, rows: pa.Table) -> pa.Table:
        found = [_unpacked(x) for x in rows["_w"].to_pylist()]
        bucket = np.repeat(rows["_b"].to_numpy(), [len(x) for x in found])
        w = np.concatenate(found)
        order = np.lexsort((bucket, w))
        w, bucket = w[order], bucket[order]
        starts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        ends = np.append(starts[1:], len(w))
        at = np.repeat(bucket[starts] != bucket[ends - 1], ends - starts)
        w, bucket = w[at], bucket[at]
        own = np.unique(bucket)
        return pa.table({"_host": pa.array([key[0].as_py()] * len(own), pa.string()), "_b": pa.array(own, pa.int64()), "_w": pa.array([np.unique(w[bucket == b]).tobytes() for b in own], pa.binary())})

    packed = streams.select("_blocks", "_host", "_b", "_n").mapInArrow(seen, "_host string, _part long, _b long, _w binary")
    return packed.groupBy("_host", "_part").applyInArrow(join, "_host string, _b long, _w binary")


def _dumped(blocks: list[Block]) -> bytes:
    return zlib.compress(json.dumps(blocks, ensure_ascii=False).encode("utf-8", "surrogatepass"), 6)


def _loaded(data: bytes) -> list[Block]:
    return [(t, s) for t, s in json.loads(zlib.decompress(data).decode("utf-8", "surrogatepass"))]


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", markup: str = "html", bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``pages``: key, url, ``text``, ``n_chars`` and ``n_removed`` (words that runs took
    out of the text).

    A host with more than ``bucket`` characters is dealt into buckets by its pages' words,
    so no task holds a whole hot host; runs that pages of different buckets share come from
    :func:`shared_windows`. Null markup is empty and gives empty text; a null url belongs to the empty host.
    Pages with the same words are one page, whatever their keys. A page of any length is one row. Other
    columns are not carried, whatever their names.
    """
    host = F.coalesce(url_parts(F.col(url))[0], F.lit(""))
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    own = f"`{key}` {kinds[key]}, `{url}` {kinds[url]}"
    made = f"{own}, text string, n_chars long, n_removed long"

    def result(columns: list[pa.Array], texts: list[str], gone: list[int]) -> pa.RecordBatch:
        return pa.record_batch([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(gone, pa.int64())], [key, url, "text", "n_chars", "n_removed"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks = [page_blocks(x or "") for x in b.column(2).to_pylist()]
            chars = [sum(len(t) + 1 for t, _ in page) for page in blocks]
            made = [pa.array(map(page_name, blocks), pa.int64()), pa.array(chars, pa.int64()), pa.array(map(_dumped, blocks), pa.binary())]
            yield pa.record_batch([b.column(0), b.column(1), b.column(3), *made], [key, url, "_host", "_name", "_chars", "_blocks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple]) -> pa.RecordBatch:
            found = main_texts([_loaded(r[2]) for r in rows], [r[5] for r in rows], shared=np.concatenate(shared) if shared else None)
            return result([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [text for text, _ in found], [gone for _, gone in found])

        group, rows, shared, types = None, [], [], []
        for b in batches:
            types = [b.schema.field(0).type, b.schema.field(1).type]
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[3:5] != group:
                    if rows:
                        yield done(rows)
                    group, rows, shared = r[3:5], [], []
                if r[6] is None:
                    rows.append(r)
                else:
                    shared.append(np.frombuffer(r[6], np.uint64))
        if rows:
            yield done(rows)

    df = pages.select(key, url, markup, host.alias("_host"))
    parsed = written(df.mapInArrow(parse, f"{own}, _host string, _name long, _chars long, _blocks binary"), "parsed")
    hosts = parsed.groupBy("_host").agg(F.ceil(F.greatest(F.sum("_chars"), F.lit(1)) / bucket).alias("_n"))
    streams = parsed.join(written(hosts, "hosts"), "_host").withColumn("_b", F.pmod("_name", "_n"))
    beyond = shared_windows(streams.where("_n > 1"))
    # the windows of a bucket stand before its pages
    rows = streams.select(key, url, "_blocks", "_host", "_b", "_name").withColumn("_w", F.lit(None).cast("binary")).unionByName(beyond, allowMissingColumns=True)
    rows = rows.repartition("_host", "_b").sortWithinPartitions("_host", "_b", F.col("_w").isNull())
    return rows.mapInArrow(run, made)


def op9_html_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
