import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_and_drop(spark, make_docs, tmp_path):
    clean = {i: " ".join(f"word{i}x{j}" for j in range(60)) for i in range(6)}
    passage = " ".join(f"shared{j}" for j in range(60))
    item = "a benchmark question with enough words in it to be found again wherever it may stand in a longer text"
    texts = dict(clean) | {10: "too short", 11: f"{clean[0]}\n{passage}", 12: f"{clean[1].replace('word1x5 ', 'changed ')}", 13: f"{' '.join(f'own{j}' for j in range(60))} {item}", 14: f"{' '.join(f'more{j}' for j in range(60))}\n{passage}", 15: None, 16: clean[2]}
    make_docs(texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        left.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if name != "SentencePiece encoding":
            assert docs.columns == corpus_pipeline.COLUMNS
    quality, lines, near, bench, tokens = left
    assert quality == set(texts) - {10, 15}
    assert lines == quality - {16}
    assert near == lines - {12}
    assert bench == near - {13} and tokens == bench
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(rows) == tokens and rows[14]["text"] == " ".join(f"more{j}" for j in range(60)) and all(r["round_trip"] for r in rows.values())
    assert rows[14]["n_chars"] == len(rows[14]["text"])


def test_odd_rows_and_empty_tables(spark, make_docs, tmp_path):
    from pyspark.sql import functions as F

    text = " ".join(f"word{j}" for j in range(60))
    docs = make_docs({1: text, 2: None, 3: "", 4: text, 5: text + " more"}).unionByName(make_docs({1: text, None: " ".join(f"own{j}" for j in range(70))}))
    docs = docs.withColumns({"kept": F.lit("clash"), "runs": F.lit("clash"), "component_id": F.lit("clash"), "ids": F.lit(None).cast("string"), "extra": F.lit(1)})
    spark.createDataFrame([(None, None, None), (1, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    spark.createDataFrame([(None, "x y z"), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "None"] and all(r["round_trip"] for r in got)
    for name in ("labels", "benchmark", "documents"):
        spark.read.parquet(f"{tmp_path}/a/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/b/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
