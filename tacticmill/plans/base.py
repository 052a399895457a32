"""The registry of queries, and what their SQL forms share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tacticmill.operators.windows import keep_first

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query, with its DuckDB form if SQL can express it."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


KEYS = {"cos_records": "cos_id", "error_records": "error_id", "reflection_records": "record_id"}


def records(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One row for each record: of repeated rows the first delivered. Columns are pruned before the shuffle."""
    key = KEYS[name]
    wanted = list(dict.fromkeys([key, *columns]))
    df = table(spark, sf_dir, name)
    return keep_first(df.select(*wanted, F.col("ingested_at").alias("_at")) if columns else df.withColumn("_at", F.col("ingested_at")), [key], ["_at"]).drop("_at")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat steps of all chains: cos_id, theorem_full_name, step_index, total_steps, tactic, state_before, state_after."""
    chains = records(spark, sf_dir, "cos_records", "theorem_name", "theorem_full_name", "full_cos_chain")
    return chains.select("cos_id", "theorem_name", "theorem_full_name", F.size("full_cos_chain").alias("total_steps"), F.posexplode("full_cos_chain").alias("step_index", "s")).select(
        "cos_id", "theorem_name", "theorem_full_name", "step_index", "total_steps", "s.tactic", "s.state_before", "s.state_after"
    )


COS = "cos AS (SELECT * FROM cos_records QUALIFY row_number() OVER (PARTITION BY cos_id ORDER BY ingested_at) = 1)"
ERR = "err AS (SELECT * FROM error_records QUALIFY row_number() OVER (PARTITION BY error_id ORDER BY ingested_at) = 1)"
REF = "ref AS (SELECT * FROM reflection_records QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY ingested_at) = 1)"
STEPS = (
    COS + ", steps AS (SELECT cos_id, theorem_name, theorem_full_name, CAST(i - 1 AS INTEGER) AS step_index, CAST(len(full_cos_chain) AS INTEGER) AS total_steps, "
    "full_cos_chain[i].tactic AS tactic, full_cos_chain[i].state_before AS state_before, full_cos_chain[i].state_after AS state_after "
    "FROM cos, unnest(range(1, len(full_cos_chain) + 1)) t(i))"
)
FIRST = r"coalesce(nullif(regexp_extract(coalesce({0}, ''), '^\s*(?:(?:·|<;>|--|\|)\s+)?(\S+)', 1), ''), '<empty>')"
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def hash_number_sql(expr: str) -> str:
    return f"CAST(('0x' || substr(md5({expr}), 1, 8)) AS UBIGINT)"
