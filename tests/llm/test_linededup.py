import random
import re

from pyspark.sql import functions as F

from spindrift.llm.linededup import dedup_lines, line_table, windows

BLANK = " \t\n\x0b\f\r"


def brute(docs, most):
    """docs: (id, text). What the operator says of each (id, text): every place against every earlier place."""
    lines = {(d, t): [x for x in t.split("\n") if x.strip(BLANK)] for d, t in docs if t is not None}
    words = lambda x: len(x.encode().split())
    places = [(d, t, i) for d, t in sorted(lines) for i in range(len(lines[d, t]))]
    same = {(d, t): [x.strip(BLANK) for x in own] for (d, t), own in lines.items()}
    gone = {x: set() for x in lines}
    for late, (d, t, i) in enumerate(places):
        for d0, t0, i0 in places[:late]:
            own, other, n, size = same[d, t], same[d0, t0], 0, 0
            while i + n < len(own) and i0 + n < len(other) and own[i + n] == other[i0 + n]:
                size += words(own[i + n])
                n += 1
            if size >= most:
                gone[d, t] |= set(range(i, i + n))
    out = {}
    for (d, t), own in lines.items():
        kept = t if not gone[d, t] else "\n".join(x for k, x in enumerate(own) if k not in gone[d, t])
        out[d, t] = (len(own), len(gone[d, t]), sum(words(own[k]) for k in gone[d, t]), kept)
    return out


def check(make_docs, texts, most):
    docs = make_docs(texts).withColumn("n_lines", F.lit("clash"))
    want = brute([(i, t) for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))], most)
    src = texts if isinstance(texts, dict) else dict(enumerate(texts))
    got = dedup_lines(docs, most).collect()
    assert len(got) == len(src)
    for r in got:
        t = src[r["doc_id"]]
        assert (r["n_lines"], r["n_removed"], r["n_removed_words"], r["text"]) == ((0, 0, 0, None) if t is None else want[r["doc_id"], t] if t.strip(BLANK) else (0, 0, 0, t)), r["doc_id"]


def test_random_texts(make_docs):
    rng = random.Random(7)
    lines = ["a b c", "d", "e f", "g h i j k l m", " n\to ", "p q", "r"]
    texts = ["\n".join(rng.choice([*lines, "", f"u{rng.random()} v"]) for _ in range(rng.randint(0, 25))) for _ in range(120)]
    check(make_docs, texts, 8)
    few = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 25))) for _ in range(60)]
    check(make_docs, few, 9)


def test_edges(make_docs):
    fifty = " ".join(f"w{i}" for i in range(50))
    texts = {4: None, 3: "", 1: f"x\n{fifty}\ny", 2: f"{fifty}\n\nz", 5: f"q\n  {fifty} ", 6: fifty[:-4], 7: "\n".join([fifty] * 300), 8: " \n\t", 9: f"x\n{fifty}\ny"}
    check(make_docs, texts, 50)
    assert dedup_lines(make_docs(texts).limit(0)).count() == 0


def test_runs_of_several_earlier_places(make_docs):
    long = " ".join(f"a{i}" for i in range(8))
    docs = make_docs({1: f"{long}\nzz zz", 2: f"q\n{long}\nx1\nx2", 3: f"r\n{long}\nx1\nx2", 4: f"x0\n{long}\nx1\nx3", 5: f"x0\n{long}\nx1\nx3\nx4"})
    got = {r["doc_id"]: r["text"] for r in dedup_lines(docs, 8).collect()}
    assert got == {1: f"{long}\nzz zz", 2: "q\nx1\nx2", 3: "r", 4: "x0\nx3", 5: "x4"}


def test_fingerprints_are_few(make_docs):
    """Every window selects one line, and neighbours mostly the same one."""
    docs = make_docs(["\n".join(f"line {i} of {d} words" for i in range(300)) for d in range(4)])
    rows = windows(line_table(docs)).select("id", "at", "fp", "i", "m").collect()
    assert all(r["i"] <= r["at"] < r["i"] + r["m"] for r in rows)
    assert len({(r["id"], r["at"]) for r in rows}) < 0.4 * len(rows)


def test_very_long_texts(make_docs):
    run = "\n".join(f"line {i} says some words" for i in range(20_000))
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in dedup_lines(make_docs({1: run, 2: f"own\n{run}\nend", 3: "x" * 3_000_000, 4: "a\n" * 30_000})).collect()}
    assert got == {1: (20_000, 0), 2: (20_002, 20_000), 3: (1, 0), 4: (30_000, 29_999)}


def test_rows_of_one_key(spark, make_docs):
    fifty = " ".join(f"w{i}" for i in range(50))
    df = make_docs({1: fifty}).unionByName(make_docs({1: fifty})).unionByName(make_docs({1: fifty + "\nmore"}))
    assert sorted((len(r["text"]), r["n_removed"]) for r in dedup_lines(df).collect()) in ([(len(fifty), 0)] * 2 + [(4, 1)], [(0, 1)] * 2 + [(len(fifty) + 5, 0)])
    later = make_docs({None: "a b\n" * 40, 2: "a b\n" * 40})
    assert sorted(re.sub(r"\s+", " ", r["text"]).strip()[:3] for r in dedup_lines(later).collect())[0] == ""
