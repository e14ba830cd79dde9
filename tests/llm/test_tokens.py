import base64
import random
import time

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spindrift.llm.sentencepiece import SuffixPieces, decode_ids, encode_texts
from spindrift.llm.tokencount import PieceCounter, pre_token_counts, token_counts

BPE, SP = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  a  b ", "don't stop\n\n  now", "<|endoftext|>x<|endoftext|>", "日本語 ok €☃ 𝔘 ـعربي", "tab\there\r\n)\r", "a" * 3000, "the " * 20_000, "\u0300x \u2028 \u00a0y", "<s> <0x0A> </s> <unk>", "123456 7890", "x\x00y"]


@pytest.fixture(scope="module")
def counter():
    return PieceCounter(BPE)


@pytest.fixture(scope="module")
def model():
    return SuffixPieces(SP, known=20)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=SP)


ANY = st.text(st.characters(exclude_categories=("Cs",)), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(ANY | st.text("ab \n▁'<|endoftext|>é", max_size=40), max_size=6))
def test_both_equal_their_libraries(counter, model, library, texts):
    bpe, sp = library
    assert counter.count(texts) == [len(bpe.encode(t, add_special_tokens=False)) for t in texts]
    ids, ends = model.encode(texts)
    got = [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    assert got == [sp.encode(t) for t in texts]
    assert [model.decode(x) for x in got] == [sp.decode(x) for x in got]


def test_token_counts(spark, make_docs, library):
    docs = make_docs(TEXTS).unionByName(make_docs({3: TEXTS[3]})).withColumn("n_tokens", F.lit("clash"))
    for most in (1_000, 3, 0):  # by the broadcast, by both, by the shuffle
        rows = token_counts(docs, BPE, most=most).collect()
        assert len(rows) == len(TEXTS) + 1
        for r in rows:
            t = TEXTS[r["doc_id"]] or ""
            n = len(library[0].encode(t, add_special_tokens=False))
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 1024)
    assert token_counts(docs.limit(0), BPE).count() == 0


def test_long_pre_tokens(spark, make_docs, library):
    """Of every length around the bounds, hot and rare ones, by each way."""
    rng = random.Random(1)
    blob = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    long = [blob(n) for n in (63, 64, 65, 66, 4_095, 4_096, 4_097, 30_000)]
    texts = [f"{rng.choice(long)} {'-' * 100} {rng.choice(long)}{'=' * 5_000} x {blob(70)}" for _ in range(30)]
    for most in (1_000, 8, 0):
        got = {r["doc_id"]: r["n_tokens"] for r in token_counts(make_docs(texts), BPE, most=most).collect()}
        assert got == {i: len(library[0].encode(t, add_special_tokens=False)) for i, t in enumerate(texts)}


def test_memory_is_bounded_by_characters():
    """Four hundred pre-tokens of 100,000 characters in a process of their own."""
    code = """
import random, resource, sys
import public_tokenizers
from spindrift.llm.tokencount import PieceCounter, blocks
counter = PieceCounter(public_tokenizers.path("byte_bpe_50k.json"))
rng = random.Random(1)
counter.count(["warm up"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
def texts():
    for _ in range(400):
        yield "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=100_000))
found = [n for part in blocks(texts()) for n in counter.count(part)]
assert len(found) == 400 and min(found) > 10_000
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) < 350


def test_pieces_are_counted_once(spark, make_docs, library):
    rows = pre_token_counts(make_docs([*TEXTS, *TEXTS]), BPE).collect()
    assert len({r["w"] for r in rows}) == len(rows)
    assert all(r["pieces"] == len(library[0].encode(r["w"], add_special_tokens=False)) for r in rows)
    assert {r["w"]: r["n"] for r in rows}[" the"] == 2 * 19_999


def test_encode_and_decode(spark, make_docs, library):
    docs = make_docs(TEXTS).withColumn("ids", F.lit("clash"))
    out = encode_texts(docs, SP)
    for r in out.collect():
        t = TEXTS[r["doc_id"]] or ""
        assert r["ids"] == library[1].encode(t) and r["n_ids"] == len(r["ids"]) and r["round_trip"] == ("▁" not in t)
    back = {r["doc_id"]: r["text"] for r in decode_ids(out.select("doc_id", "ids"), SP).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    assert encode_texts(docs.limit(0), SP).count() == 0


def test_long_texts_without_blanks(model, library):
    rng = random.Random(3)
    texts = ["".join(rng.choice("etaoinshrdlu日é") for _ in range(n)) for n in (98, 99, 100, 101, 20_000)]
    texts += ["ab" * 50_000, "-" * 30_000 + "=" * 3_000, base64.b64encode(rng.randbytes(750_000)).decode()]
    began = time.time()
    ids, ends = model.encode(texts)
    assert time.time() - began < 30
    for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True):
        assert ids[a:b].tolist() == library[1].encode(t)


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        PieceCounter(public_tokenizers.path("word_bpe_49k.json"))
