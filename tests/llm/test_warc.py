import gzip
import hashlib
import os
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm.common import scratch_path
from spindrift.llm.warc import LoserTree, _sort_key, merge_runs, read_archives, read_run, url_key, write_archives, write_run

LINES = st.tuples(st.sampled_from("abc"), st.sampled_from("12"), st.integers(0, 5), st.just(""), st.just(""), st.sampled_from("xyz"), st.integers(0, 99), st.just(0))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(LINES, max_size=8), max_size=9))
def test_loser_tree_merges(runs):
    runs = [sorted(r, key=_sort_key) for r in runs]
    got = list(LoserTree([iter(r) for r in runs]))
    assert [_sort_key(x) for x in got] == sorted(_sort_key(x) for r in runs for x in r)


PAGES = [
    (5, "http://b.example.com/x?y#z", "p" * 200),
    (2, "http://a.example.com/", "p" * 200),
    (9, "http://a.example.com/", "p" * 200),
    (7, None, None),
    (8, "", ""),
    (1, "http://a.example.com/é b\tc", "short"),
    (3, "http://a.example.com/2", "short"),
    (4, "http://a.example.com/3", "q" * 99 + "é"),
    (6, "http://a.example.com/4", "q" * 99 + "é"),
    (10, "http://z.org", "\r\n\r\nWARC/1.1\r\n" * 20 + "x" * 400_000),
    (2, "http://a.example.com/", "p" * 200),
    (None, "http://n.org/", "no id, and long enough to be a revisit of something else, if there were another one ........................"),
]


def expected(rows):
    first = {}
    for p, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 100 and p is not None:
            first[raw] = min(first.get(raw, p), p)
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        again = p is not None and raw in first and first[raw] < p
        out.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[raw] if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "clash") for r in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    base = scratch_path(spark, "test")
    index = merge_runs(write_archives(pages, base), base, range_lines=3)
    got = sorted((tuple(r)[:5] for r in read_archives(index, base).collect()), key=repr)
    assert got == expected(PAGES)
    order = [tuple(r) for r in index.orderBy("part", "at").select("urlkey", "ts", "page_id").collect()]
    assert order == sorted(order) and len(order) == len(PAGES)
    root = base.removeprefix("file://")
    names = [n for n in os.listdir(root) if n.endswith(".warc.gz")]
    text = b"".join(gzip.open(os.path.join(root, n)).read() for n in names)
    assert text.count(b"WARC-Type: revisit") == 3 and not [n for n in os.listdir(root) if n.endswith(".part")]


def test_many_runs_take_passes(spark):
    rng = random.Random(5)
    rows = [(i, f"http://h{rng.randint(0, 30)}.org/{rng.randint(0, 9)}", "x" * rng.randint(0, 300)) for i in range(2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(13)
    base = scratch_path(spark, "test")
    index = merge_runs(write_archives(pages, base), base, fan_in=4, range_lines=150)
    keys = [tuple(r) for r in index.orderBy("part", "at").select("urlkey", "ts", "page_id").collect()]
    assert keys == sorted(keys) and len(keys) == 2000 and index.select("part").distinct().count() > 1
    assert read_archives(index, base).count() == 2000


def test_one_url_with_many_captures(spark):
    """Ranges cut between captures of one URL, and every bound is found in every run."""
    rows = [(i, "http://hot.org/" if i % 5 else None, f"{i}") for i in range(6000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    base = scratch_path(spark, "test")
    index = merge_runs(write_archives(pages, base), base, range_lines=600, samples=7)
    keys = [tuple(r) for r in index.orderBy("part", "at").select("urlkey", "ts", "page_id").collect()]
    assert keys == sorted(keys) and len(keys) == 6000
    assert merge_runs(write_archives(pages, scratch_path(spark, "test")), base, range_lines=600).groupBy("part").count().agg({"count": "max"}).first()[0] < 3000


def test_lines_are_found_by_bisecting(tmp_path):
    rng = random.Random(2)
    lines = sorted({(f"k{rng.randint(0, 40)}" + "x" * rng.randint(0, 30), "1", rng.randint(0, 9), "d", "response", "f", k, 1) for k in range(300)}, key=_sort_key)
    uri = write_run(f"file://{tmp_path}", "run", lines)[0]
    for k in (0, 1, 2, 50, 298, 299):
        assert [_sort_key(x) for x in read_run(uri, _sort_key(lines[k]), None)] == [_sort_key(x) for x in lines[k:]]
        assert len(list(read_run(uri, None, _sort_key(lines[k])))) == k
    assert list(read_run(uri, ("z", "", 0, "", 0), None)) == [] and len(list(read_run(uri, ("", "", 0, "", 0), None))) == len(lines)


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    base = scratch_path(spark, "test")
    assert read_archives(merge_runs(write_archives(pages, base), base), base).count() == 0


def test_url_key():
    assert url_key("https://WWW.Example.com/A?b#c") == "com,example,www)/A?b" and url_key(None) == "" and url_key("http://x.org?q") == "org,x)?q"
