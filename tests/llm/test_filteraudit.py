import random
import re
from collections import Counter
from itertools import permutations

import duckdb

from spindrift.llm.filteraudit import FILTERS, OP12_SQL, audit, judged_documents, op12_filter_interaction_audit

DOCS = "doc_id long, text string, lang string, n int, `A` string, part string"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(rows):
    """Flags of every row by their definition."""
    smallest = {}
    for d, t, *_ in rows:
        if d is not None:
            smallest[t or ""] = min(smallest.get(t or "", d), d)
    for d, t, lang, *_ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        yield d, lang or "", {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": d is not None and smallest[t] < d,
        }


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    judged = list(fails(rows))
    out, total = {}, Counter()
    for part in {p for _, p, _ in judged}:
        mine = [(d, f) for d, p, f in judged if p == part]
        for order in permutations(FILTERS):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [x for x in left if x[1][name]]
                left = [x for x in left if not x[1][name]]
                total[part, name] += len(gone)
                out[part, "".join(order), step] = (
                    len(left), len(gone), sum(f[name] for _, f in mine) - len(gone), sum(f[name] and sum(f.values()) == 1 for _, f in mine),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), name)
    return {k: (*v[:-1], total[k[0], v[-1]]) for k, v in out.items()}


def found(df):
    assert df.columns == COLUMNS
    got = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got}
    assert len(out) == len(got)
    return out


def made(rng, n):
    words = ["ab", "Cd", "EF", "x#", "é", "Á", "zz", "q|", *(f"w{i}" for i in range(150))]
    texts = [None, "", " \t\n\x0b\f\r", " A", "a", "AB c", "a\x1cb\xa0c $", "x " * 99 + "y", " ".join(f"w{i}" for i in range(100)), " ".join(f"w{i % 80}" for i in range(100)), " ".join(f"w{i % 79}" for i in range(100)) + "\n"]
    texts += [" ".join(rng.choices(words[rng.choice([0, 4, 8]) :], k=rng.choice([5, 90, 100, 130, 400]))) for _ in range(n // 3)]
    return [(rng.choice([None, rng.randrange(n), rng.randrange(n)]), rng.choice(texts), rng.choice([None, "", "en", "de"]), 7, "clash", "other") for _ in range(n)]


def test_equals_brute_force(spark):
    rng = random.Random(4)
    rows = made(rng, 150)
    rows += rows[:20]  # repeated rows
    labels = [(rng.choice([None, rng.randrange(150)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(120)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = found(audit(judged_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), FILTERS, lost={"good_lost": "good", "toxic_lost": "toxic"}))
    assert got == brute(rows, labels)


def test_very_long_text_and_hot_copies(spark):
    rows = [(i, "same old text " * 40, "en", 0, "", "") for i in range(2_000)] + [(5_000, "Word " * 1_000_000, "en", 0, "", ""), (None, "same old text " * 40, "en", 0, "", "")]
    labels = [(i, 1, 0) for i in range(0, 2_000, 2)]
    got = found(audit(judged_documents(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), FILTERS, lost={"good_lost": "good", "toxic_lost": "toxic"}))
    assert got["en", "EABCD", 1] == (3, 1_999, 0, 0, 999, 0, 120 // 2 * 1_999)
    assert got["en", "BEACD", 2] == (0, 0, 1_999, 0, 0, 0, 120 // 2 * 1_999)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "en", 0, "", "")], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    lost = {"good_lost": "good", "toxic_lost": "toxic"}
    assert found(audit(judged_documents(docs.limit(0), labels), FILTERS, lost=lost)) == {}
    got = found(audit(judged_documents(docs, labels), FILTERS, lost=lost))
    assert len(got) == 600 and got["en", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120) and got["en", "BCDEA", 4] == (1, 0, 0, 0, 0, 0, 0)


def test_other_filters(spark):
    """Any filters with a flag column; counts of equal rows."""
    rows = spark.createDataFrame([("p", True, False, 3), ("p", True, True, 2), ("p", False, False, 5), (None, False, True, 1)], "part string, X boolean, Y boolean, n long")
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in audit(rows, "XY").collect()}
    assert got == {("p", "XY", 1): (5, 5, 0, 3, 8), ("p", "XY", 2): (5, 0, 2, 0, 2), ("p", "YX", 1): (8, 2, 0, 0, 2), ("p", "YX", 2): (5, 3, 2, 3, 8),
                   (None, "XY", 1): (1, 0, 0, 0, 0), (None, "XY", 2): (0, 1, 0, 1, 2), (None, "YX", 1): (0, 1, 0, 1, 2), (None, "YX", 2): (0, 0, 0, 0, 0)}


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = con.execute(OP12_SQL).fetchall()
    assert found(op12_filter_interaction_audit(spark, folder)) == {tuple(r[:3]): tuple(r[3:]) for r in want}
