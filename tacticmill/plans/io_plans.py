"""Scans, sinks, streams and kernels on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tacticmill.functions import text as X
from tacticmill.operators import joins as J
from tacticmill.plans.base import ERR, STEPS, query, records, steps, table
from tacticmill.session import shared_path
from tacticmill.sources import io, kernel
from tacticmill.streaming import streams


@query("SELECT CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines FROM documents WHERE text IS NOT NULL")
def text_lines(spark, d):
    return table(spark, d, "documents").where("text is not null").agg(F.sum(F.size(F.split("text", "\n"))).alias("lines"))


@query("SELECT name, type_expr, module_path, coalesce(nullif(doc_text, ''), name) AS docstring FROM corpus")
def metadata_export(spark, d):
    return table(spark, d, "corpus").select("name", "type_expr", "module_path", F.coalesce(F.nullif("doc_text", F.lit("")), "name").alias("docstring"))


@query("SELECT name, type_expr, proof_steps, proof_mode FROM corpus")
def json_lines_roundtrip(spark, d):
    """Written as JSON lines into the shared folder and read back with a schema."""
    c = table(spark, d, "corpus").select("name", "type_expr", "proof_steps", "proof_mode")
    path = shared_path(spark, "corpus-json")
    io.write_json_lines(c, path)
    return io.read_json_lines(spark, path, c.schema)


@query("SELECT split, count(*) AS n FROM reflection_records WHERE split = 'test' GROUP BY 1")
def split_fallback(spark, d):
    return io.split_with_fallback(table(spark, d, "reflection_records").select("split")).groupBy("split").agg(F.count("*").alias("n"))


@query(f"WITH {ERR} SELECT error_id, error_type FROM err")
def resumed_run(spark, d):
    """Two runs over one output: the second adds only what the first left."""
    e = records(spark, d, "error_records", "error_type")
    out = shared_path(spark, "resume")
    io.run_resumable(e.where("error_type = 'tactic_typo'"), ["error_id"], out, lambda x: x, 0)
    return io.run_resumable(e, ["error_id"], out, lambda x: x, 1).select("error_id", "error_type")


@query("SELECT DISTINCT event_id, event_type FROM events")
def stream_dedup(spark, d):
    """Events through a stream with keyed dedup."""
    path = _event_folder(spark, d)
    s = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return streams.drain(streams.first_by_key(s, ["event_id"], "ts").select("event_id", "event_type"), streams.fresh_output(spark, "events"))


def _event_folder(spark, d) -> str:
    """The events as a folder of files, as an append source would leave them."""
    path = shared_path(spark, "event-source")
    table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).repartition(4).write.parquet(path)
    return path


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    """Hourly counts of the events. An extra beside the batch operators."""
    path = _event_folder(spark, d)
    s = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    out = streams.fresh_output(spark, "windows")

    def keep(batch, _):
        batch.write.mode("overwrite").parquet(out)

    done = streams.drain(streams.windowed_counts(s, "ts", "event_type", "value", late="3650 days"), out, "complete", keep)
    return done.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT DISTINCT event_id, user_id FROM events")
def stream_append_unseen(spark, d):
    """Micro-batches appended exactly once by key."""
    path = _event_folder(spark, d)
    s = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path).select("event_id", "user_id")
    out = streams.fresh_output(spark, "append")
    return streams.drain(s, out, each=streams.append_unseen(["event_id"], out))


@query()
def verified_errors(spark, d):
    """Every error replayed against the stand-in kernel, or with the status that says why there is no chain to replay."""
    from tacticmill.plans.join_plans import _replays

    e = _replays(spark, d, "error_tactic")
    rows = e.select("error_id", X.text(F.col("state_before")).alias("goal"), "replay", "error_tactic", "status")
    return kernel.verify(rows, lambda: kernel.StandInKernel(0.3))


@query()
def traced_runs(spark, d):
    """State pairs of each chain from the stand-in kernel, up to the first failing tactic."""
    s = steps(spark, d)
    runs = J.prefix(s, "cos_id", "step_index", "tactic").join(s.where("step_index = 0").select("cos_id", X.text(F.col("state_before")).alias("goal")), "cos_id")
    return kernel.trace(runs.select(F.col("cos_id").alias("run_id"), "goal", F.col("values").alias("tactics")), lambda: kernel.StandInKernel(0.2))
