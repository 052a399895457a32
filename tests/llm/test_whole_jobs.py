"""The training-text operators give every row they owe."""

import os

import pytest
from pyspark.sql import functions as F

from tacticmill.llm.encoding import DEFAULT_DIR, DEFAULT_VOCABULARY
from tacticmill.llm.mixing import mixture
from tacticmill.llm.residue import residue_cases, scan_texts

PATH = os.path.join(os.environ.get("TOKENIZERS", DEFAULT_DIR), DEFAULT_VOCABULARY)


@pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files here")
def test_a_text_of_a_listed_source_is_kept_whoever_else_posts_it(spark):
    rows = [(1, "hot text", None), (2, "hot text", "unlisted"), (3, "hot text", "a"), (4, "hot text", "b"), (5, "other text", "b"), (6, "no target", "zero")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1), ("zero", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mixture(df, targets, "doc_id", "text", "source", PATH)
    assert {(r["doc_id"], r["source"], r["copies"]) for r in mixed.collect()} == {(3, "a", 1), (5, "b", 1)}
    assert all(r["available"] == 2 for r in report.collect())


def test_coverage_depends_on_shares_not_on_size(spark):
    for size in (100, 2000):
        rows = [(i, "to be written walnut cedar maple" if i % 10 == 0 else "orchard") for i in range(size)]
        df = spark.createDataFrame(rows, "key long, text string")
        got = residue_cases([scan_texts(df, "key", {"text": F.col("text")}, "t")]).collect()
        assert {r["row_id"] for r in got} == set(range(0, size, 10))
