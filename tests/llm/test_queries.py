"""Every query of the subpackage runs over its whole tables."""

import pytest

from tacticmill.llm.queries import oracle_sql, queries
from tests.compare import compare

COLUMNS = {
    "p1_found": ["record_id", "defect"], "p2_found": ["record_id_a", "record_id_b"], "p3_found": ["record_id_a", "record_id_b"], "p4_found": ["table_name", "row_id", "field"],
    "p5_found": ["cos_id"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "kind", "start_pos", "end_pos"],
}


@pytest.mark.parametrize("name", sorted(queries()))
def test_runs(spark, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    rows = df.collect()
    assert df.columns == COLUMNS.get(name, df.columns) and rows
    assert len({repr(r) for r in rows}) == len(rows)


def test_assignment_keeps_theorems_whole(spark, sf_dir):
    out = queries()["p5_assign"](spark, sf_dir)
    assert out.groupBy("theorem").agg({"assigned": "min"}).count() == out.select("theorem", "assigned").distinct().count()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    assert compare(spark, queries()[name], oracle_sql()[name], sf_dir) is None
