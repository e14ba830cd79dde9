import random

from pyspark.sql import functions as F

from spindrift.llm.decontaminate import Items, budget, find_items, normalised, original_span, without_items


def edits(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(item):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_equals_brute_force():
    rng = random.Random(11)
    parts = ["the", "an", "tion", "er", "he", "on", "ed"]
    make = lambda n: " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))
    items = [(i, make(rng.randint(1, 25))) for i in range(14)]
    texts = []
    for _ in range(120):
        s = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, int(len(s) * 0.13))):
            p, kind = rng.randrange(len(s) + 1), rng.randrange(3)
            s[p : p + (kind != 0)] = [] if kind == 1 else [rng.choice("abcde ")]
        texts.append(normalised(f"{make(rng.randint(0, 10))} {''.join(s)} {make(rng.randint(0, 10))}"))
    found = Items(items).search(texts)
    for t, got in zip(texts, found, strict=True):
        for i, s in items:
            e = edits(s, t)
            assert (i in got) == (e <= budget(len(s))), (s, t)
            if i in got:
                n, a, b = got[i]
                assert n == e == edits(s, t[a:b])


def test_repeated_characters_equal_brute_force():
    rng = random.Random(5)
    items = [(0, "-" * 60), (1, "ab" * 30), (2, "| a | " + "-" * 40 + " | b of the table |"), (3, "=" * 30 + " heading " + "=" * 30), (4, "x" * 9)]
    texts = [normalised(t) for t in ["-" * 59, "-" * 200, "c " + "-" * 50 + "d" * 4 + "-" * 9, "ab" * 27 + "c" + "ba" * 30, "| a | " + "-" * 38 + " | b of the table |", "x" * 8, "= " * 50, "=" * 28 + " heading " + "=" * 500, ""]]
    for _ in range(60):
        s = list(rng.choice(items)[1] * rng.randint(1, 3))
        for _ in range(rng.randint(0, 8)):
            p = rng.randrange(len(s) + 1)
            s[p : p + rng.randint(0, 1)] = rng.choice(["", "-", "z", "ab"])
        texts.append(normalised("".join(s)))
    for t, got in zip(texts, Items(items).search(texts), strict=True):
        for i, s in items:
            e = edits(s, t)
            assert (i in got) == (e <= budget(len(s))), (s, t)
            if i in got:
                n, a, b = got[i]
                assert n == e == edits(s, t[a:b])


def equal_brute(items, texts, **how):
    for t, got in zip(texts, Items(items, **how).search(texts), strict=True):
        for i, s in items:
            e = edits(s, t)
            assert (i in got) == (e <= budget(len(s))), (s, t)
            if i in got:
                n, a, b = got[i]
                assert n == e == edits(s, t[a:b])


def test_cut_items_equal_brute_force():
    """Heads and tails of items at both ends of the first, middle and last text, texts shorter than an item,
    items longer than every text."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(60)]
    make = lambda n: " ".join(rng.choices(words, k=n))
    items = [(0, make(12)), (1, make(40)), (2, make(90)), (3, "ab " * 60 + "end")]
    for _ in range(12):
        cut = []
        for _ in range(3):
            s = rng.choice(items)[1]
            at = int(len(s) * rng.choice([0, 0.02, 0.05, 0.07, 0.09, 0.2, 0.4, 0.5, 0.6, 0.9]))
            part, other = rng.choice([s[at:], s[: len(s) - at]]), make(rng.choice([0, 0, 3, 20]))
            cut.append(normalised(rng.choice([f"{part} {other}", f"{other} {part}", part])))
        for piece in (256, 24):
            equal_brute(items, cut, piece=piece)


def test_pieces_equal_brute_force():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcde", k=rng.randint(2, 6))) for _ in range(12)]
    make = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, make(n)) for i, n in enumerate((5, 20, 60, 60))]
    texts = []
    for _ in range(40):
        s = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, int(len(s) * 0.1))):
            p, kind = rng.randrange(len(s) + 1), rng.randrange(3)
            s[p : p + (kind != 0)] = [] if kind == 1 else [rng.choice("abcde ")]
        texts.append(normalised(f"{make(rng.randint(0, 30))} {''.join(s)} {make(rng.randint(0, 30))}"))
    equal_brute(items, texts, piece=24)


def test_long_item_against_text_of_its_words():
    import time

    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(30)]
    make = lambda n: " ".join(rng.choices(words, k=2 * n))[:n]
    item, text = make(8_000), make(1_200_000)
    began = time.time()
    found = Items([(1, item)]).search([text, text[:5_000] + item[:4_000] + "x" + item[4_000:]])
    assert time.time() - began < 8
    assert found == [{}, {1: (1, 5_000, 13_001)}]


def test_repeated_characters_need_no_pairs():
    import resource
    import time

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    began = time.time()
    found = Items([(1, "e" * 2_000), (2, "-" * 80 + " a heading of the table")]).search(["e" * 1_000_000, "-" * 300_000, "b"])
    assert found[0] == {1: (0, 0, 2_000)} and found[1:] == [{}, {}]
    assert time.time() - began < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


def test_passes(spark, make_docs):
    """Items in several passes give what one pass gives."""
    items = [(i, f"{ITEM[i:]} item number {i} of them") for i in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = make_docs({i: f"so {t} it is" for i, t in items[::2]} | {10: "none of them"})
    one, many = (sorted(map(tuple, find_items(docs, bench, most=n).collect())) for n in (1 << 20, 150))
    assert one == many and len(one) >= 3
    assert [r["doc_id"] for r in without_items(docs, bench, most=150).collect()] == [10]


def test_spans_point_into_the_text():
    text = "  Über\n\n das  WORT é"
    n = normalised(text)
    for a in range(len(n)):
        for b in range(a + 1, len(n) + 1):
            if not (n[a].isspace() or n[b - 1].isspace()):
                x, y = original_span(text, a, b)
                assert normalised(text[x:y]) == n[a:b]


ITEM = "the quick brown fox jumps over the lazy dog while nobody in the whole wide village looks at it"


def test_operator(spark, make_docs):
    texts = {0: f"x {ITEM.upper()} y", 1: ITEM.replace(" ", "\n "), 2: ITEM.replace("lazy", "lasy"), 3: ITEM[: len(ITEM) // 2], 4: None, 5: "", 6: "z " * 200_000 + ITEM, 7: f"{ITEM} {ITEM}", 8: "unrelated words"}
    bench = spark.createDataFrame([(1, ITEM, "x"), (2, ITEM, "x"), (3, None, "x"), (4, "", "x"), (5, "y", "x")], "item_id long, text string, doc_id string")
    docs = make_docs(texts).unionByName(make_docs({0: texts[0]})).withColumn("edits", F.lit("clash"))
    got = find_items(docs, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got if r["item_id"] in (1, 2)) == sorted((d, i) for d in (0, 0, 1, 2, 6, 7) for i in (1, 2))
    for r in got:
        if r["item_id"] == 1:
            assert normalised(texts[r["doc_id"]][r["start"] : r["stop"]]).replace("lasy", "lazy") == ITEM and r["edits"] == (r["doc_id"] == 2)
    assert sorted(r["doc_id"] for r in without_items(docs, bench.where("item_id < 5")).collect()) == [3, 4, 5, 8]
    assert find_items(docs.limit(0), bench).count() == 0 and find_items(docs, bench.limit(0)).count() == 0
    assert without_items(docs, bench.limit(0)).count() == docs.count()
