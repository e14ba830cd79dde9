"""Readers and writers: JSON lines, JSON documents, CSV, YAML lists, Markdown, sample files of harnesses."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterable
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.text import unquoted
from spindrift.operators.pairs import last_per_id, last_read, score
from spindrift.schemas import CANONICAL_WRONG, SENTENCE_KEYS, MissingColumns, require_columns


class NotFound(FileNotFoundError):
    """No file of the names that a reader looks for."""


def _place(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The file system that a path lies in, and the path in its terms."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _place(spark, path)
    return store.exists(where)


def children(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(name, is a folder) of what lies in a folder, sorted."""
    store, where = _place(spark, path)
    return sorted((s.getPath().getName(), s.isDirectory()) for s in store.listStatus(where))


def files_below(spark: SparkSession, folder: str, prefix: str = "", suffix: str = "") -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of the files at any depth whose names have prefix and suffix, in the order of
    their paths; an empty list where there is no such folder."""
    store, where = _place(spark, folder)
    if not store.exists(where):
        return []
    out, found = [], store.listFiles(where, True)
    while found.hasNext():
        s = found.next()
        if s.getPath().getName().startswith(prefix) and s.getPath().getName().endswith(suffix):
            out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sorted(out)


def remove(spark: SparkSession, path: str) -> None:
    store, where = _place(spark, path)
    store.delete(where, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """A file to another place of the same file system, whose folders are made."""
    store, where = _place(spark, to)
    store.mkdirs(where.getParent())
    if not store.rename(_place(spark, path)[1], where):
        raise OSError(f"cannot move {path} to {to}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there as a whole or not at all: it is written beside its place and renamed."""
    store, where = _place(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{uuid.uuid4().hex}")
    out = store.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    store.delete(where, False)
    if not store.rename(beside, where):
        raise OSError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as one string; empty if it is empty."""
    first = spark.read.text(path, wholetext=True).first()
    return first[0] if first else ""


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema; unknown fields are left, missing ones null."""
    return spark.read.schema(schema).json(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """One JSON document or array of documents; None if there is none or it cannot be read."""
    if not exists(spark, path):
        return None
    df = spark.read.schema(f"{schema}, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    good = df.where("_bad is null")
    return good.drop("_bad") if good.head(1) else None


def results_path(spark: SparkSession, folder: str, fallback: bool = True) -> str:
    """``merged_results.jsonl`` of an experiment, else (with ``fallback``) ``results.jsonl``."""
    for name in ["merged_results.jsonl", *["results.jsonl"] * fallback]:
        if exists(spark, f"{folder}/{name}"):
            return f"{folder}/{name}"
    raise NotFound(folder)


def read_merged(spark: SparkSession, folder: str, schema: str, fallback: bool = True) -> DataFrame:
    df = read_lines(spark, results_path(spark, folder, fallback), schema)
    return require_columns(df, "qid", "probe_variant", "output_letter", "gold").withColumn("experiment", F.lit(folder.rstrip("/").rsplit("/", 1)[-1]))


def experiments(spark: SparkSession, root: str, need: str | None = None) -> list[str]:
    """Folders of experiments, hidden ones aside; with ``need`` only those that have that file."""
    return [n for n, is_folder in children(spark, root) if is_folder and not n.startswith(".") and (need is None or exists(spark, f"{root}/{n}/{need}"))]


def read_sentences(spark: SparkSession, path: str) -> DataFrame | None:
    """Tier sentences from a JSON array, whether or not each object wraps them in ``sentences``; one pair of
    surrounding quotes is taken off."""
    keys = ", ".join(f"{k} string" for k in SENTENCE_KEYS)
    df = read_document(spark, path, f"question_id string, {keys}, sentences struct<{keys.replace(' string', ': string')}>")
    if df is None:
        return None
    return df.select("question_id", *(unquoted(F.coalesce(F.col(f"sentences.{k}"), F.col(k))).alias(k) for k in SENTENCE_KEYS))


def require_variant(df: DataFrame, variant: str = "bare") -> DataFrame:
    """The table; an error if no row has that variant."""
    if not df.where(F.col("probe_variant") == variant).head(1):
        raise MissingColumns(f"no row of the variant {variant}, which the others are compared with")
    return df


def read_compared(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """An experiment's merged table for the metrics that compare with the rows without sources: these must be there,
    and ``canonical_wrong`` is that of the question in ``canonical_wrong.jsonl``, null if it has none."""
    df = require_columns(read_merged(spark, folder, schema, fallback=False), "probs")
    if not exists(spark, f"{folder}/canonical_wrong.jsonl"):
        raise NotFound(f"{folder}/canonical_wrong.jsonl")
    wrong = last_read(read_lines(spark, f"{folder}/canonical_wrong.jsonl", CANONICAL_WRONG).select("qid", "canonical_wrong"), ["qid"])
    return require_variant(df.drop("canonical_wrong").join(wrong, "qid", "left"))


def complete_reasoning(reasoning: DataFrame, questions: DataFrame, seen: Observation | None = None) -> DataFrame:
    """``qid, thinking_with_tags`` of every question (``id``): its last trace, empty if that is null.

    A question without a trace is an error of the plan that reads it, so nothing is counted before. ``seen`` observes
    ``questions`` and how many traces are ``empty`` on the way.
    """
    last = last_read(reasoning.select("qid", F.coalesce("thinking_with_tags", F.lit("")).alias("_t")), ["qid"])
    lacking = F.raise_error(F.concat(F.lit("no reasoning for question "), "id")).cast("string")
    df = questions.select("id").join(last.withColumnRenamed("qid", "id"), "id", "left").select(F.col("id").alias("qid"), F.coalesce("_t", lacking).alias("thinking_with_tags"))
    return df if seen is None else df.observe(seen, F.count("*").alias("questions"), F.count_if(F.col("thinking_with_tags") == "").alias("empty"))


def sample_files(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """The sample files of a harness at any depth, sorted."""
    return [path for path, *_ in files_below(spark, folder, prefix, ".jsonl")]


def first_file(spark: SparkSession, folder: str, prefix: str, suffix: str) -> str | None:
    """The first of the files that match, those of fewer folders deep before others; None without one."""
    found = files_below(spark, folder, prefix, suffix)
    return min((p for p, *_ in found), key=lambda p: (p.count("/"), p), default=None)


def subject(path: Column, marker: str = "pro") -> Column:
    """The token after ``_<marker>_`` in a file's name."""
    return F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), f"_{marker}_([^_.]+)", 1)


def subtask(path: Column, marker: str) -> Column:
    """All tokens after the marker up to the first that is longer than ten characters or a number."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.jsonl$", "")
    tokens = F.split(F.regexp_extract(stem, f"_{marker}_(.*)$", 1), "_")
    stop = F.array_position(F.transform(tokens, lambda t: (F.length(t) > 10) | t.rlike(r"^\d+$")), True).cast("int")
    return F.array_join(F.when(stop > 0, F.slice(tokens, F.lit(1), stop - 1)).otherwise(tokens), "_")


def read_samples(spark: SparkSession, paths: list[str] | str, topic: Column | None = None, prefix: str = "samples") -> DataFrame:
    """``topic, doc_id, score``: of repeated samples the last (by file and place in it) counts. ``paths`` are files, or
    a folder whose files at any depth count if their names begin with ``prefix`` and end with ``.jsonl``."""
    reader = spark.read.schema("doc_id long, acc double, exact_match double, target string")
    if isinstance(paths, str):
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", f"{prefix}*.jsonl")
    df, file = reader.json(paths), F.col("_metadata.file_path")
    place = F.struct(file, F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    df = df.select((topic if topic is not None else subject(file)).alias("topic"), "doc_id", score().alias("score"), place.alias("at"))
    return last_per_id(df, ["topic", "doc_id"], "at").drop("at")


def preferred(results: dict[str, Any], keys: Iterable[str]) -> float:
    """The first of the keys that the results have; 0.0 without any."""
    return next((float(results[k]) for k in keys if k in results), 0.0)


def first_results(spark: SparkSession, folder: str) -> dict[str, Any] | None:
    """The first results document of a harness below a folder."""
    path = first_file(spark, folder, "results_", ".json")
    return json.loads(read_text(spark, path)) if path else None


def write_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, compressed by gzip: they are written and read whole, and repeat their names and texts in every row."""
    df.write.mode(mode).option("compression", "gzip").json(path)


def log_calls(spark: SparkSession, rows: list[dict], path: str) -> None:
    """Append calls of a model to a log of JSON lines; each row gets the time as text."""
    from spindrift.schemas import CALL_LOG

    stamped = [{"timestamp": datetime.now().isoformat(), **r} for r in rows]
    spark.createDataFrame(stamped, CALL_LOG).write.mode("append").json(path)


def plain(value: Any) -> Any:
    """For JSON: NaN and infinities are null."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def write_document(spark: SparkSession, value: Any, path: str) -> None:
    """One JSON document, whole or not at all."""
    write_text(spark, path, json.dumps(plain(value), indent=2, ensure_ascii=False, allow_nan=False))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def append_report(spark: SparkSession, new: DataFrame, path: str, key: str = "experiment") -> None:
    """Append the experiments that the CSV report does not have, its columns matched by name."""
    from spindrift.operators.report import new_only

    if not exists(spark, path):
        return write_csv(new, path)
    old = spark.read.option("header", True).csv(path)
    fresh = new_only(new, old, key)
    fresh = fresh.select(*(F.col(c) if c in fresh.columns else F.lit(None).cast("string").alias(c) for c in old.columns))
    write_csv(fresh, path, "append")


def write_once(df: DataFrame, path: str) -> None:
    """Skipped where the target is there already."""
    df.write.mode("ignore").json(path)


def materialise(splits: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Write each split as JSON lines under a folder, or nothing where all are there already; gives the
    manifest (name to path)."""
    paths = {name: f"{folder}/{name}.jsonl" for name in splits}
    for name, df in splits.items():
        if not all(exists(df.sparkSession, p) for p in paths.values()):
            df.write.mode("overwrite").json(paths[name])
    return paths


def markdown_table(df: DataFrame, columns: list[str]) -> str:
    """A small report table: the frame is gathered, so it must be one row a model or subject."""
    rows = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    for r in df.select(columns).toLocalIterator():
        rows.append("| " + " | ".join("N/A" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |")
    return "\n".join(rows) + "\n"


def yaml_list(key: str, names: list[str]) -> str:
    return f"{key}:\n" + "".join(f"- {n}\n" for n in names)


def read_yaml(text: str) -> dict[str, Any]:
    """Flat YAML maps of scalars and lists, as recipes and configurations use; the library if it is there."""
    try:
        import yaml
    except ModuleNotFoundError:
        pass
    else:
        return yaml.safe_load(text) or {}
    out: dict[str, Any] = {}
    key = None
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line or line.lstrip().startswith("#"):
            continue
        if line.lstrip().startswith("- ") and key:
            out[key] = [*(out[key] or []), line.lstrip()[2:].strip().strip("\"'")]
            continue
        key, _, value = line.partition(":")
        key, value = key.strip(), value.strip()
        if value.startswith("[") and value.endswith("]"):
            out[key] = [v.strip().strip("\"'") for v in value[1:-1].split(",") if v.strip()]
        else:
            out[key] = value.strip("\"'") or None
    return out
