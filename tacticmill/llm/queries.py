"""Queries p1 .. p8 over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tacticmill.llm.components import fill_deficits, load_table, save_table, theorem_key, torn, update_table
from tacticmill.llm.disclosure import personal_items, sanitised
from tacticmill.llm.encoding import encode_corpus, vocabulary_path
from tacticmill.llm.mixing import mixture
from tacticmill.llm.near import near_groups, near_pairs
from tacticmill.llm.overlap import overlap_pairs, overlap_report
from tacticmill.llm.pairs import pair_defects
from tacticmill.llm.residue import residue_cases, scan_texts
from tacticmill.session import cut, shared_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_defects(_table(spark, sf_dir, "reflection_records"), "record_id", "error_message", "reflection", "ingested_at")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(_table(spark, sf_dir, "reflection_records"), "record_id", ["reflection", "thought"])


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each record that has a near-duplicate: group, class of copies, number of links."""
    return near_groups(_table(spark, sf_dir, "reflection_records"), "record_id", ["reflection", "thought"])


def _residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = F.concat(F.col("full_cos_chain.state_before"), F.col("full_cos_chain.state_after"))
    return residue_cases(
        [
            scan_texts(_table(spark, sf_dir, "cos_records"), "cos_id", {"full_cos_chain": chain}, "cos_records"),
            scan_texts(_table(spark, sf_dir, "reflection_records"), "record_id", {"state_before": F.col("state_before"), "state_after": F.col("state_after")}, "reflection_records"),
        ]
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = _residue(spark, sf_dir).where("table_name = 'reflection_records' and field = 'state_before'").select("row_id")
    return overlap_pairs(_table(spark, sf_dir, "reflection_records"), "record_id", "split", ["theorem_name", "state_before", "original_tactic"], ["state_before"], bad)


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation records, and those that recur in train, by split and source."""
    return overlap_report(_table(spark, sf_dir, "reflection_records"), cut(p3_found(spark, sf_dir), "p3"), "record_id", "split", "source")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _residue(spark, sf_dir)


def _theorem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, row_id, spelling, node, recorded): node is the theorem's one spelling."""
    rows = [
        _table(spark, sf_dir, name).select(
            F.lit(name).alias("table_name"), F.col(key).alias("row_id"), F.col("theorem_full_name").alias("spelling"), theorem_key(F.col("theorem_full_name")).alias("node"), F.col("split").alias("recorded")
        )
        for name, key in (("cos_records", "cos_id"), ("reflection_records", "record_id"))
    ]
    return rows[0].union(rows[1])


def _links(rows: DataFrame) -> DataFrame:
    return rows.select("spelling", "node").distinct().select(F.col("spelling").alias("record"), F.array("spelling", "node").alias("keys"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _theorem_rows(spark, sf_dir)
    table = cut(update_table(None, _links(rows)), "p5-table")
    parts = torn(table, rows.select(F.col("spelling").alias("node"), F.col("recorded").alias("split")))
    nodes = table.join(parts, "component", "left_semi").select(F.col("node").alias("spelling"))
    return rows.where("table_name = 'cos_records'").join(nodes, "spelling", "left_semi").select(F.col("row_id").alias("cos_id")).distinct()


def p5_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split for every record: chains as the first batch of the component table, reflections as the second."""
    rows, ratios = _theorem_rows(spark, sf_dir), _table(spark, sf_dir, "split_targets")
    # a folder of this run; a pipeline names one and goes on from what it holds
    folder = shared_path(spark, "p5-components")
    for batch in ("cos_records", "reflection_records"):
        part = rows.where(F.col("table_name") == batch)
        table = cut(update_table(load_table(spark, folder), _links(part)), "p5-table")
        seen = rows if batch == "reflection_records" else part
        records = seen.select("table_name", "row_id", F.col("spelling").alias("node")).distinct()
        sizes = records.join(table, "node").groupBy("component").agg(F.count("*").alias("records"))
        table = save_table(fill_deficits(table, sizes, ratios), folder)
    out = rows.select("table_name", "row_id", F.col("spelling").alias("node")).distinct().join(table, "node")
    return out.select("table_name", "row_id", F.col("component").alias("theorem"), F.col("split").alias("assigned"), "status")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(_table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary_path(spark))


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixture(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "source_targets"), "doc_id", "text", "source", vocabulary_path(spark))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen texts with their number of copies."""
    return _mixture(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of tokens by source."""
    return _mixture(spark, sf_dir)[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_items(_table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with typed placeholders."""
    documents = _table(spark, sf_dir, "documents")
    return sanitised(documents, cut(personal_items(documents, "doc_id", "text"), "p8"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_groups, p3_found, p3_report, p4_found, p5_found, p5_assign, p6_ids, p7_mix, p7_shares, p8_found, p8_text)}


_KEY = r"regexp_replace(replace(replace(regexp_replace(theorem_full_name, '^\s+|\s+$', '', 'g'), '«', ''), '»', ''), '^(_root_\.)+', '')"
_P5 = f"""WITH u AS (SELECT cos_id, theorem_full_name, split FROM cos_records UNION ALL SELECT NULL, theorem_full_name, split FROM reflection_records),
p AS (SELECT cos_id, split, string_split({_KEY}, '.') AS s FROM u WHERE theorem_full_name IS NOT NULL),
k AS (SELECT cos_id, split, array_to_string(list_filter(s, lambda x, i: i = 1 OR x <> s[i - 1]), '.') AS theorem FROM p)
SELECT DISTINCT cos_id FROM k WHERE cos_id IS NOT NULL AND theorem <> '' AND theorem IN (SELECT theorem FROM k GROUP BY theorem HAVING count(DISTINCT split) > 1)"""


def oracle_sql() -> dict[str, str]:
    """The others compare texts by alignment, sketches, tokenizers or corpus statistics and are tested against brute force."""
    return {"p5_found": _P5}
