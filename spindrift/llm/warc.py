"""WARC archives with an external index merge.

Writing: each task turns its pages into gzip members of WARC/1.1 records and keeps one index line a
record (URL key, timestamp, page, digest, file, offset, length). A run of index lines is sorted in
memory and written beside its archive when the archive is full. Merging: runs are combined by a k-way
loser tree in (URL key, timestamp, page) order; more runs than the fan-in are merged in passes, and the
last pass merges ranges of that whole order in parallel, so that the parts follow one another in global
order and a URL with many captures is shared out too. A range finds its first line in each run by bisecting
the file; the driver sees a bounded sample of the lines, for the ranges' bounds only. Reading: index lines
lead to their records, whose payload digests are verified; archives are shared out over the tasks.

Files carry the task attempt in their names and are renamed when complete, so an attempt that is lost
leaves an orphan that no index names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import delete, scratch_path, table, written

#: Payloads shorter than this are never revisits.
LEAST_PAYLOAD = 100
#: Bytes after which an archive is closed, runs that one merge opens, lines of which one may be a sample,
#: lines of a range, samples the driver sees (they set the ranges' balance only), and tasks that read.
ARCHIVE_BYTES, FAN_IN, SPARSE, RANGE_LINES, SAMPLES, READERS = 128 << 20, 512, 512, 500_000, 50_000, 10_000
INDEX = "urlkey string, ts string, page_id long, digest string, record_type string, file string, offset long, length long"
Line = tuple[str, str, int, str, str, str, int, int]
Place = tuple[str, str, int, str, int]  # URL key, timestamp, page, file, offset: no two lines are equal


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels from the top-level one down, then ``)`` and the rest."""
    if not url:
        return ""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:] or "/"
    return _plain(",".join(reversed(host.split("."))) + ")" + path)


def _plain(s: str) -> str:
    """Without characters that end a header or a field."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in s)


def timestamp(key: Column) -> Column:
    """Capture time for tables without one: 2024-01-01 plus the key in seconds."""
    return F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce(key, F.lit(0)), F.lit(1 << 31))), "yyyyMMddHHmmss")


def record(page: int | None, url: str | None, ts: str, payload: bytes, digest: str, first: int | None) -> bytes:
    """One record: a response with the payload, or a revisit (``first`` given) with the headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if first is None else b"")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page}:{digest}")
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {ts[:4]}-{ts[4:6]}-{ts[6:8]}T{ts[8:10]}:{ts[10:12]}:{ts[12:14]}Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_plain(url)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    head.append(f"X-Page-Id: {'' if page is None else page}")
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{first}:{digest}')}>", f"X-Refers-To-Page-Id: {first}"]
    head += [f"Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


# -- runs ------------------------------------------------------------------------------------


def _sort_key(x: Line) -> Place:
    return x[0], x[1], x[2], x[5], x[6]


def write_run(base: str, name: str, lines: Iterable[Line]) -> tuple[str, int, list[Place]]:
    """Write sorted lines; gives path, number of lines, and the place of every ``SPARSE``-th."""
    files, root = filesystem(base)
    path = f"{root}/{name}.cdx"
    places, n = [], 0
    with files.open_output_stream(f"{path}.part") as out:
        for x in lines:
            if n % SPARSE == 0:
                places.append(_sort_key(x))
            out.write(("\t".join(map(str, x)) + "\n").encode())
            n += 1
    files.move(f"{path}.part", path)
    return f"{base}/{name}.cdx", n, places


def _line(raw: bytes) -> Line:
    a = raw.decode().rstrip("\n").split("\t")
    return a[0], a[1], int(a[2]), a[3], a[4], a[5], int(a[6]), int(a[7])


def seek_line(f, size: int, low: Place) -> None:
    """Put a run's file at its first line that is not below a place, by bisecting its bytes."""
    a, b = 0, size  # lines that begin before a are below, those from b on are not
    while a < b:
        mid = (a + b) // 2
        f.seek(mid)
        if mid:
            f.seek(mid - 1)
            f.readline()  # the rest of the line before
        at = f.tell()
        raw = f.readline()
        if at >= b or not raw or _sort_key(_line(raw)) >= low:
            b = mid
        else:
            a = at + len(raw)
    f.seek(a)
    if a:
        f.seek(a - 1)
        f.readline()


def read_run(uri: str, low: Place | None, high: Place | None) -> Iterator[Line]:
    """Lines of a run from one place up to another, without that."""
    import io

    files, path = filesystem(uri)
    with files.open_input_file(path) as f:
        lines = io.BufferedReader(f, 1 << 16)
        if low is not None:
            seek_line(lines, f.size(), low)
        for raw in lines:
            x = _line(raw)
            if high is not None and _sort_key(x) >= high:
                return
            yield x


class LoserTree:
    """k-way merge: each inner node keeps the loser of its match, so the next winner costs one path."""

    def __init__(self, sources: list[Iterator[Line]]):
        self.sources, self.k = sources, len(sources)
        self.heads = [next(s, None) for s in sources]
        self.keys = [None if h is None else _sort_key(h) for h in self.heads]
        self.loser = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._play(leaf, building=True)

    def _beats(self, a: int, b: int) -> bool:
        ka, kb = self.keys[a], self.keys[b]
        return kb is None or (ka is not None and (ka, a) < (kb, b))

    def _play(self, leaf: int, building: bool = False) -> None:
        """Carry a leaf's head up; while building it waits at the first node that nobody has reached."""
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            other = self.loser[node]
            if other < 0:
                if building:
                    self.loser[node] = winner
                    return
            elif self._beats(other, winner):
                self.loser[node], winner = winner, other
            node //= 2
        self.loser[0] = winner

    def __iter__(self) -> Iterator[Line]:
        while self.k and self.keys[w := self.loser[0]] is not None:
            yield self.heads[w]
            self.heads[w] = head = next(self.sources[w], None)
            self.keys[w] = None if head is None else _sort_key(head)
            self._play(w)


# -- writing ---------------------------------------------------------------------------------


def with_first(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Adds ``_payload``, ``_digest`` and ``_first``: the smallest key with the same payload, where that
    is another one and the payload is long enough, else null."""
    df = pages.withColumn("_payload", F.coalesce(F.col(html), F.lit("")).cast("binary")).withColumn("_digest", F.sha2("_payload", 256))
    same = df.where(F.octet_length("_payload") >= LEAST_PAYLOAD).groupBy("_digest").agg(F.min(key).alias("_first"), F.max(key).alias("_last")).where("_first < _last")
    same = written(same.select("_digest", "_first"), "payloads")  # its size is known when the join is planned
    df = df.join(same, "_digest", "left")
    return df.withColumn("_first", F.when(F.col("_first") < F.col(key), F.col("_first")))


def write_archives(pages: DataFrame, base: str, key: str = "page_id", url: str = "url", html: str = "html", ts: Column | None = None) -> DataFrame:
    """Write the archives under ``base``; gives the manifest of index runs (one row a run).

    A null html is an empty payload, a null url has no target; both are written. A null key is kept as
    none. Rows with the same key and payload are all responses if the key is the smallest. An empty
    table writes nothing.
    """
    df = with_first(pages, key, html).select(F.col(key).cast("long"), url, ts if ts is not None else timestamp(F.col(key)), "_payload", "_digest", "_first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, root = filesystem(base)
        files.create_dir(root, recursive=True)
        task = TaskContext.get()
        stem, seq = f"{task.partitionId():06d}-{task.taskAttemptId()}", 0
        out, lines, at = None, [], 0

        def close() -> tuple[str, int, list[Place]]:
            out.close()
            files.move(f"{root}/{stem}-{seq}.warc.gz.part", f"{root}/{stem}-{seq}.warc.gz")
            lines.sort(key=_sort_key)
            return write_run(base, f"{stem}-{seq}", lines)

        made = []
        for b in batches:
            for page, link, when, payload, digest, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    out, lines, at = files.open_output_stream(f"{root}/{stem}-{seq}.warc.gz.part"), [], 0
                raw = record(page, link, when, payload, digest, first)
                out.write(raw)
                lines.append((url_key(link), when, -1 if page is None else page, digest, "response" if first is None else "revisit", f"{stem}-{seq}.warc.gz", at, len(raw)))
                at += len(raw)
                if at >= ARCHIVE_BYTES:
                    made.append(close())
                    out, seq = None, seq + 1
        if out is not None:
            made.append(close())
        yield _manifest(made)

    return written(df.mapInArrow(run, _MANIFEST), "runs")


PLACE = "urlkey string, ts string, page_id long, file string, offset long"
_MANIFEST = f"run string, n long, places array<struct<{PLACE.replace(' ', ':').replace(',:', ',')}>>"


def _manifest(rows: list) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
    place = pa.struct(list(zip(("urlkey", "ts", "page_id", "file", "offset"), kinds, strict=True)))
    runs, n, places = list(zip(*rows, strict=True)) or [(), (), ()]
    named = [[dict(zip(place.names, p, strict=True)) for p in x] for x in places]
    return pa.record_batch([pa.array(runs, pa.string()), pa.array(n, pa.int64()), pa.array(named, pa.list_(place))], ["run", "n", "places"])


# -- merging ---------------------------------------------------------------------------------


def merge_runs(manifest: DataFrame, base: str, fan_in: int = FAN_IN, range_lines: int = RANGE_LINES, samples: int = SAMPLES) -> DataFrame:
    """All index lines with ``part`` and ``at``: ordered by those, they are in global order."""
    spark = manifest.sparkSession
    level = 0
    while (count := manifest.count()) > fan_in:
        names = manifest.select("run").orderBy("run")
        groups = -(-count // fan_in)

        def combine(rows: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            runs = [r for b in rows for r in b.column(0).to_pylist()]
            made = []
            for i in range(0, len(runs), fan_in):
                tree = LoserTree([read_run(r, None, None) for r in runs[i : i + fan_in]])
                made.append(write_run(base, f"merged-{level}-{TaskContext.get().taskAttemptId()}-{i}", tree))
            yield _manifest(made)

        manifest = written(names.repartition(groups).mapInArrow(combine, _MANIFEST), "runs")
        level += 1
    names = [r["run"] for r in manifest.select("run").orderBy("run").collect()]  # at most fan_in
    total, sparse = manifest.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("places")), F.lit(0))).first()
    # about ``samples`` of the places; with few of them all
    seen = manifest.select(F.explode("places").alias("p")).select("p.*")
    if sparse > samples:
        seen = seen.where(F.pmod(F.xxhash64("file", "offset"), F.lit(-(-sparse // samples))) == 0)
    seen = sorted(map(tuple, seen.collect()))
    parts = max(1, -(-total // range_lines), min(spark.sparkContext.defaultParallelism, total // SPARSE))
    splits = sorted({seen[i * len(seen) // parts] for i in range(1, parts)}) if seen else []
    bounds = [None, *splits, None]
    ranges = [(i, bounds[i], bounds[i + 1]) for i in range(len(bounds) - 1)] if names else []

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        fields = ["part", "at", "urlkey", "ts", "page_id", "digest", "record_type", "file", "offset", "length"]
        for b in batches:
            for part, low, high in zip(*(c.to_pylist() for c in b.columns), strict=True):
                low, high = (None if x is None else tuple(x.values()) for x in (low, high))
                rows, at = [], 0
                for x in LoserTree([read_run(n, low, high) for n in names]):
                    rows.append((part, at, *x))
                    at += 1
                    if len(rows) == 10_000:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], fields)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], fields)

    kind = f"struct<{PLACE.replace(' ', ':').replace(',:', ',')}>"
    todo = spark.createDataFrame(ranges, f"part int, low {kind}, high {kind}")
    return written(todo.repartition(max(1, len(ranges)), "part").mapInArrow(merge, f"part int, at long, {INDEX}"), "index")


# -- reading ---------------------------------------------------------------------------------


def read_archives(index: DataFrame, base: str) -> DataFrame:
    """Read every record that the index names; a payload that does not match its digest is an error. Archives
    are dealt to as many tasks as there are, ``READERS`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(base)
        name, f = None, None
        for b in batches:
            rows = []
            for file, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file != name:
                    if f is not None:
                        f.close()
                    name, f = file, files.open_input_file(f"{root}/{file}")
                f.seek(offset)
                warc, http, payload = parse(f.read(length))
                digest, kind = warc["WARC-Payload-Digest"].removeprefix("sha256:"), warc["WARC-Type"]
                size = int(http["Content-Length"])
                if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"damaged record in {file} at {offset}")
                page, first = warc["X-Page-Id"], warc.get("X-Refers-To-Page-Id")
                rows.append((int(page) if page else None, size, digest, kind, int(first) if first else None, warc.get("WARC-Target-URI"), warc["WARC-Date"]))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "date"])

    readers = max(1, min(READERS, index.select("file").distinct().count()))
    todo = index.select("file", "offset", "length").repartition(readers, "file").sortWithinPartitions("file", "offset")
    return todo.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, date string")


def op3_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_path(spark, "warc")
    index = merge_runs(write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), base), base)
    rows = written(read_archives(index, base).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "records")
    delete(spark, base)  # the archives were this query's own
    return rows


OP3_SQL = """
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first < page_id THEN first END AS refers_to
FROM f
"""
