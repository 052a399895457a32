"""Every query with a SQL form against DuckDB; the others by shape, keys and direct calls of their parsers."""

import pytest

from tacticmill.plans import registry
from tests.compare import compare, connect

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, con, name):
    assert compare(spark, QUERIES[name], SQL[name], sf_dir, con) is None


# queries without an SQL form: their columns, a key that no two rows share, and whether the small tables hold rows for them
PLAIN = {
    "cell_index_recall": (["wanted", "found", "recall"], ["wanted"], True), "contrastive_samples": (["qid", "positive", "negatives", "num_negatives", "split"], ["qid", "positive"], True),
    "correction_pairs": (["cos_id", "step_index", "tactic", "faulty"], ["cos_id", "step_index"], True), "dataset_pipeline": (["kind", "cos_id", "step_index", "tactic", "error_type", "error_tactic", "split"], None, True),
    "error_replays": (["error_id", "cos_id", "status", "n", "replay"], ["error_id"], True), "namespace_ranges": (["doc_id", "name", "start", "end"], ["doc_id", "start", "end"], False),
    "parsed_outputs": (["error_id", "thought", "tactic"], ["error_id"], True), "repair_loop": (["error_id", "success", "route", "repaired_tactic", "attempts"], ["error_id"], True),
    "self_play": (["theorem", "tactics", "origin"], None, False), "state_search": (["theorem", "solved", "nodes", "tactics"], ["theorem"], True), "tree_search": (["theorem", "solved", "nodes", "tactics"], ["theorem"], True),
    "tactic_block_counts": (["cos_id", "step_index", "blocks", "goals", "words"], ["cos_id", "step_index"], True), "theorem_sources": (["doc_id", "n", "name", "type", "proof_mode", "tactics"], ["doc_id", "n"], True),
    "traced_runs": (["run_id", "step_index", "tactic", "state_before", "state_after"], ["run_id", "step_index"], True), "verified_errors": (["error_id", "verification_status", "error_message"], ["error_id"], True),
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_shape_without_sql(spark, sf_dir, name):
    columns, key, rows = PLAIN[name]
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    assert df.columns == columns and (bool(got) or not rows)
    if key:
        assert len({tuple(r[k] for k in key) for r in got}) == len(got)


def _steps(con):
    from tacticmill.plans.base import STEPS

    return con.execute(f"WITH {STEPS} SELECT cos_id, step_index, tactic, state_before FROM steps").fetchall()


def test_parsers_over_whole_tables(spark, sf_dir, con):
    """The parsing queries against the parsers called one by one on the rows as DuckDB reads them."""
    import hashlib

    from tacticmill.functions import parsing as Y
    from tacticmill.plans.base import ERR

    want = {(c, i): (len(Y.tactic_blocks(t)), len(Y.goals(s)), len(Y.split_arguments(t))) for c, i, t, s in _steps(con)}
    assert {(r["cos_id"], r["step_index"]): (r["blocks"], r["goals"], r["words"]) for r in QUERIES["tactic_block_counts"](spark, sf_dir).collect()} == want
    answers = con.execute(f"WITH {ERR} SELECT error_id, '[Thought] ' || coalesce(thought, '') || chr(10) || '[Tactic] ' || coalesce(original_tactic, '') FROM err").fetchall()
    assert {r["error_id"]: (r["thought"], r["tactic"]) for r in QUERIES["parsed_outputs"](spark, sf_dir).collect()} == {i: tuple(Y.parse_output(a)) for i, a in answers}
    sources = con.execute("SELECT doc_id, text FROM documents WHERE source = 'lean_source'").fetchall()
    blocks = {(d, n): b for d, t in sources for n, b in enumerate(Y.theorem_blocks(t))}
    got = {(r["doc_id"], r["n"]): (r["type"], r["proof_mode"], r["tactics"]) for r in QUERIES["theorem_sources"](spark, sf_dir).collect()}
    assert got.keys() == blocks.keys()
    for k, block in blocks.items():
        body = block.split(":=", 1)[1].strip() if ":=" in block else ""
        assert got[k] == (hashlib.md5(Y.type_expression(block).encode()).hexdigest(), Y.proof_mode(body), len(Y.tactic_lines(body)))


def test_comparison_sees_a_difference(spark, sf_dir, con):
    assert compare(spark, QUERIES["corpus_gate"], "SELECT name, type_expr FROM corpus LIMIT 3", sf_dir, con)
