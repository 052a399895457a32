"""Scans and sinks: directories, whole files, JSON lines and arrays, checkpoints, patches, run state."""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKIPPED_DIRS = ("test", "deprecated", ".lake")


def scan_files(spark: SparkSession, root: str, suffix: str = ".lean", skip: tuple[str, ...] = SKIPPED_DIRS) -> DataFrame:
    """(path, text) of every file with the suffix below root, directories named like one in skip pruned."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").option("ignoreCorruptFiles", True).text(root, wholetext=True)
    parts = F.split(F.regexp_replace("path", "^.*?" + root.rstrip("/").replace(".", r"\."), ""), "/")
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).where(~F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(*skip)))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines. Strict: a bad line fails the read. Tolerant: it becomes a row of NULLs with the line in _corrupt_record. Blank lines are skipped."""
    reader = spark.read.schema(schema)
    if strict:
        return reader.option("mode", "FAILFAST").json(path)
    full = T.StructType([*(T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON array or JSON lines, told by the first character that is not blank."""
    head = spark.read.text(path).select(F.regexp_extract("value", r"^\s*(\S)", 1).alias("c")).where("c <> ''").limit(1).collect()
    return spark.read.schema(schema).option("multiLine", bool(head) and head[0]["c"] == "[").json(path)


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def line_count(spark: SparkSession, path: str) -> int:
    """Lines, blank ones included."""
    return spark.read.text(path).count()


def write_stats(stats: DataFrame, path: str) -> None:
    stats.coalesce(1).write.mode("overwrite").json(path)


def pending(df: DataFrame, done_path: str, keys: list[str]) -> DataFrame:
    """Rows whose key no earlier run has written; without an earlier run all rows."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(done_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return df
    return df.join(spark.read.schema(df.select(*keys).schema).parquet(done_path).distinct(), keys, "left_anti")


def run_resumable(df: DataFrame, keys: list[str], out: str, transform: Callable[[DataFrame], DataFrame], batch: int = 0) -> DataFrame:
    """Transforms what is pending and appends it under batch_id=...; a rerun adds only what is missing."""
    transform(pending(df, out, keys)).withColumn("batch_id", F.lit(batch)).write.mode("append").partitionBy("batch_id").parquet(out)
    return df.sparkSession.read.parquet(out)


def missing_batches(spark: SparkSession, out: str, expected: int) -> DataFrame:
    have = spark.read.parquet(out).select(F.col("batch_id").cast("long").alias("id")).distinct()
    return spark.range(expected).join(have, "id", "left_anti")


def patched(df: DataFrame, path: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Writes the changed table to a new version beside the old one and checks that no row was lost."""
    spark = df.sparkSession
    version = f"{path.rstrip('/')}.v{datetime.datetime.now(datetime.timezone.utc):%Y%m%d%H%M%S%f}"
    change(df).write.parquet(version)
    new = spark.read.parquet(version)
    if new.count() != df.count():
        raise ValueError(f"{version} has another number of rows than the table it patches")
    return new


def split_with_fallback(df: DataFrame, column: str = "split", order: tuple[str, ...] = ("test", "valid", "val")) -> DataFrame:
    """Rows of the first split that has any; all rows if none has."""
    have = {r[0] for r in df.select(column).where(F.col(column).isin(*order)).distinct().collect()}
    for name in order:
        if name in have:
            return df.where(F.col(column) == name)
    return df


def theorem_statements(files: DataFrame, text: str = "text") -> DataFrame:
    """(name, arguments, type) of each declaration of a file, by pattern."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)(theorem\s+\S+.*?:=)"), 1)
    one = files.select(*[c for c in files.columns if c != text], F.posexplode(found).alias("n", "d"))
    # bracket groups may hold colons of their own
    shape = r"(?s)^theorem\s+(\S+)\s*((?:\([^()]*\)|\{[^{}]*\}|\[[^\[\]]*\]|[^:(\[{])*?)\s*:(?!=)\s*(.*?)\s*:=$"
    return one.select("*", *[F.regexp_extract("d", shape, i).alias(c) for i, c in enumerate(("name", "arguments", "type"), 1)]).drop("d")


def write_vectors(df: DataFrame, path: str, cell: str | None = None) -> None:
    """Vectors as ARRAY<FLOAT> in Parquet, sorted by cell so that a probe prunes row groups."""
    (df.repartition(cell).sortWithinPartitions(cell) if cell else df).write.mode("overwrite").parquet(path)


@dataclass
class RunState:
    """Status of the steps of a pipeline, kept as one JSON text."""

    steps: dict[str, dict] = field(default_factory=dict)

    def start(self, step: str) -> None:
        self.steps[step] = {"status": "started", "started_at": _now()}

    def complete(self, step: str, output: str) -> None:
        self.steps.setdefault(step, {}).update(status="completed", completed_at=_now(), output_path=output)

    def fail(self, step: str, error: str) -> None:
        self.steps.setdefault(step, {}).update(status="failed", completed_at=_now(), error=error)

    def to_json(self) -> str:
        return json.dumps(self.steps, ensure_ascii=False, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> RunState:
        return cls(json.loads(text))

    def remaining(self, order: list[str], resume_from: str | None = None, disabled: frozenset[str] = frozenset()) -> list[str]:
        """Steps to run: from the given one on, or those not completed; disabled ones never."""
        if resume_from is not None:
            order = order[order.index(resume_from) :]
        else:
            order = [s for s in order if self.steps.get(s, {}).get("status") != "completed"]
        return [s for s in order if s not in disabled]


def run_pipeline(state: RunState, steps: dict[str, Callable[[], str]], resume_from: str | None = None, disabled: frozenset[str] = frozenset(), dry_run: bool = False) -> list[str]:
    """Runs the steps in order and stops at the first failure; a dry run only names them."""
    todo = state.remaining(list(steps), resume_from, disabled)
    if dry_run:
        return todo
    for step in todo:
        state.start(step)
        try:
            state.complete(step, steps[step]())
        except Exception as error:
            state.fail(step, str(error))
            raise
    return todo


def _now() -> str:
    return datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


def with_retries(call: Callable, attempts: int = 3, base: float = 0.1, longest: float = 60.0, pause: Callable[[float], None] | None = None):
    """call's result; a failed call is made again after base * 2^n seconds, at most ``longest``, times a random factor from 0.5 to 1.5."""
    import random
    import time

    for attempt in range(attempts):
        try:
            return call()
        except Exception:
            if attempt == attempts - 1:
                raise
            (pause or time.sleep)(min(base * 2**attempt, longest) * (0.5 + random.random()))


class Pace:
    """Lets at most ``rate`` calls a second start, whichever thread makes them."""

    def __init__(self, rate: float | None):
        import threading

        self.gap, self.next, self.lock = 1 / rate if rate else 0.0, 0.0, threading.Lock()

    def __call__(self) -> None:
        import time

        with self.lock:
            now = time.monotonic()
            at = max(now, self.next)
            self.next = at + self.gap
        if at > now:
            time.sleep(at - now)


def in_batches(df: DataFrame, call: Callable[[list[dict]], list[dict]], schema: str, size: int = 64, attempts: int = 3, concurrency: int = 1, rate: float | None = None) -> DataFrame:
    """An external service as a partition function: batches of fixed size, retries with growing pauses and jitter.

    A task has at most ``concurrency`` calls under way and starts at most ``rate`` of them a second; the
    number of partitions multiplies both. Answers keep the order of their batches.
    """

    def run(frames: Iterator) -> Iterator:
        from concurrent.futures import ThreadPoolExecutor

        import pandas as pd

        pace = Pace(rate)

        def once(part: list[dict]) -> list[dict]:
            pace()
            return call(part)

        with ThreadPoolExecutor(concurrency) as pool:
            for frame in frames:
                rows = frame.to_dict("records")
                parts = [rows[i : i + size] for i in range(0, len(rows), size)]
                for answer in pool.map(lambda part: with_retries(lambda: once(part), attempts), parts):
                    yield pd.DataFrame(answer)

    return df.mapInPandas(run, schema)


def load_config(path: str) -> dict:
    """A nested configuration from a JSON or YAML file; an empty file is an empty configuration. YAML needs its library."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            import json

            return json.loads(f.read() or "{}")
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML files need the yaml library; use JSON") from e
        return yaml.safe_load(f) or {}


def check_environment(paths: dict[str, str], modules: list[str] = ()) -> list[tuple[str, str, bool]]:
    """(name, what, found) for each path that should exist and each module that should import."""
    import importlib.util
    import os

    return [(name, "path", os.path.exists(path)) for name, path in paths.items()] + [(m, "module", importlib.util.find_spec(m) is not None) for m in modules]


def observed(df: DataFrame, name: str = "progress", **conditions) -> tuple[DataFrame, object]:
    """df with a row counter and one counter for each condition, filled by whichever action runs it; no extra pass."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in conditions.items()]), seen
