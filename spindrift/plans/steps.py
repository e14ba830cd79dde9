"""A graph of named steps whose results are written and committed, so that a run goes on where another ended."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from spindrift.sources import files

#: The marker that a result is whole.
MARKER = "COMMITTED.json"


@dataclass(frozen=True)
class Step:
    """``make`` turns the tables that the step needs (inputs or earlier steps, by name) into its result. Another
    ``version`` makes earlier results of it and of what needs it void."""

    name: str
    needs: tuple[str, ...]
    make: Callable[[dict[str, DataFrame]], DataFrame]
    version: str = "1"


@dataclass(frozen=True)
class Outcome:
    """What became of a step: ``run``, ``reused``, ``failed`` or ``left``; in a dry run what would."""

    name: str
    action: str
    rows: int | None = None
    error: str | None = None


class StepFailed(RuntimeError):
    """A step did not end; ``outcomes`` has those before it, itself and those after it."""

    def __init__(self, name: str, outcomes: list[Outcome]):
        super().__init__(f"step {name} failed")
        self.outcomes = outcomes


def _digest(*parts: str) -> str:
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def input_fingerprint(spark: SparkSession, df: DataFrame) -> str:
    """Of the files that a table is read from: their paths, sizes and times of change; of a table without files
    its plan."""
    paths = sorted(df.inputFiles())
    if not paths:
        return _digest(str(df.semanticHash()))
    known: dict[str, tuple[str, int, int]] = {}
    for folder in {p.rsplit("/", 1)[0] for p in paths}:
        known |= {p.split(":", 1)[-1].lstrip("/"): (p, *rest) for p, *rest in files.files_below(spark, folder)}
    return _digest(*(repr(known.get(p.split(":", 1)[-1].lstrip("/"), p)) for p in paths))


def fingerprints(spark: SparkSession, steps: list[Step], inputs: dict[str, DataFrame]) -> dict[str, str]:
    """Of every input and step: a step's covers its name, version and all that it needs."""
    out = {name: input_fingerprint(spark, df) for name, df in inputs.items()}
    for s in steps:
        if s.name in out:
            raise ValueError(f"two steps or inputs are named {s.name}")
        if lacking := [n for n in s.needs if n not in out]:
            raise ValueError(f"step {s.name} needs {', '.join(lacking)}, which no input or earlier step gives")
        out[s.name] = _digest(s.name, s.version, *(out[n] for n in s.needs))
    return out


def committed(spark: SparkSession, folder: str) -> dict | None:
    """What the marker of a result says; None where the result is not whole."""
    path = f"{folder}/{MARKER}"
    return json.loads(files.read_text(spark, path)) if files.exists(spark, path) else None


def run_graph(spark: SparkSession, steps: list[Step], inputs: dict[str, DataFrame], folder: str, start: str | None = None, dry: bool = False) -> tuple[dict[str, DataFrame], list[Outcome]]:
    """Run the steps in order; gives their results and outcomes.

    Each result is written under ``folder`` by name and fingerprint and then marked as whole by a file that is renamed
    into place. A marked result is reused; one without a marker, from a run that was cut off, is made anew. With
    ``start`` that step and those after it are run even if they are there, and those before must be there. A
    failure stops the run (:class:`StepFailed`); what was marked before stays. ``dry`` runs nothing and gives no results.
    """
    names = [s.name for s in steps]
    first = names.index(start) if start else 0
    prints = fingerprints(spark, steps, inputs)
    tables, outcomes = dict(inputs), []
    for i, s in enumerate(steps):
        place = f"{folder}/{s.name}/{prints[s.name]}"
        marker = committed(spark, place)
        again = start is not None and i >= first
        if marker is None and start is not None and i < first:
            raise ValueError(f"step {s.name} before {start} has no result")
        if marker is not None and not again:
            outcomes.append(Outcome(s.name, "reused", marker["rows"]))
        elif dry:
            outcomes.append(Outcome(s.name, "run"))
            continue
        else:
            files.remove(spark, f"{place}/{MARKER}")
            try:
                s.make({n: tables[n] for n in s.needs}).write.mode("overwrite").parquet(f"{place}/data")
            except Exception as e:
                left = [Outcome(n, "left") for n in names[i + 1 :]]
                raise StepFailed(s.name, [*outcomes, Outcome(s.name, "failed", error=str(e)), *left]) from e
            made = spark.read.parquet(f"{place}/data")
            rows = made.count()  # of the files' footers
            files.write_text(spark, f"{place}/{MARKER}", json.dumps({"step": s.name, "version": s.version, "needs": {n: prints[n] for n in s.needs}, "rows": rows, "schema": made.schema.simpleString()}))
            outcomes.append(Outcome(s.name, "run", rows))
        if not dry:
            tables[s.name] = spark.read.parquet(f"{place}/data")
    return ({} if dry else {n: tables[n] for n in names}), outcomes


def write_log(spark: SparkSession, folder: str, name: str, outcomes: list[Outcome], lines: list[str] | None = None) -> str:
    """The text log of a run, under the time of its writing: one line a step, then more ``lines``; gives its path."""
    path = f"{folder}/{name}_{datetime.now():%Y%m%d_%H%M%S_%f}.log"
    said = [" ".join([o.name, o.action, *([] if o.rows is None else [f"{o.rows} rows"]), *([o.error.splitlines()[0]] if o.error else [])]) for o in outcomes]
    files.write_text(spark, path, "\n".join([*said, *(lines or [])]) + "\n")
    return path
