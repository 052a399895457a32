import random

import pytest
from pyspark.sql import functions as F

from tacticmill.llm.components import components, fill_deficits, load_table, save_table, settle, theorem_key, torn, update_table


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(100)] + [(500, 500), (0, 600 + seed)]
    df = spark.createDataFrame([*edges, *edges[:9], (None, 3)], "a int, b int")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == union_find(edges)


def test_empty(spark):
    assert components(spark.createDataFrame([], "a int, b int")).collect() == []
    assert update_table(None, spark.createDataFrame([], "record string, keys array<string>")).collect() == []


@pytest.mark.parametrize(
    "name, key",
    [(" A.b\n", "A.b"), ("A.«b_c»", "A.b_c"), ("_root_.A.b", "A.b"), ("A.A.b", "A.b"), ("A.b.b", "A.b"), ("A.b'", "A.b'"), ("A.b_aux", "A.b_aux"), ("B.b", "B.b"), ("_example", "_example"), ("\tA.b", "A.b"), ("", None), (None, None), ("  ", None)],
)
def test_theorem_key(spark, name, key):
    assert spark.createDataFrame([(name,)], "n string").select(theorem_key(F.col("n"))).first()[0] == key


def _links(spark, rows):
    return spark.createDataFrame(rows, "record string, keys array<string>")


def test_increments_keep_splits_and_quarantine_conflicts(spark):
    first = update_table(None, _links(spark, [("r1", ["a", "b"]), ("r2", ["c"]), ("r3", ["d"]), ("r4", [None])]))
    splits = {"a": "train", "c": "val", "d": "test"}
    table = first.withColumn("split", F.create_map(*[F.lit(x) for kv in splits.items() for x in kv])[F.col("component")])
    second = {r["node"]: r for r in update_table(table, _links(spark, [("r5", ["b", "e"]), ("r6", ["c", "d", "f"]), ("r7", ["g"])])).collect()}
    assert (second["e"]["component"], second["e"]["split"], second["e"]["status"]) == ("a", "train", "kept")
    assert {second[n]["status"] for n in "cdf"} == {"quarantined"} and second["c"]["split"] == "val" and second["d"]["split"] == "test" and second["f"]["split"] is None
    assert second["g"]["status"] == "new" and second["g"]["split"] is None
    assert {r["node"]: r["split"] for r in update_table(table, _links(spark, [])).collect()} == {r["node"]: r["split"] for r in table.collect()}


def test_a_conflict_stays_until_it_is_settled(spark, tmp_path):
    folder = str(tmp_path / "table")
    assert load_table(spark, folder) is None
    first = update_table(None, _links(spark, [("r1", ["a"]), ("r2", ["b"]), ("r3", ["x", "y"])]))
    given = {"a": "train", "b": "test", "x": "val"}
    save_table(first.withColumn("split", F.create_map(*[F.lit(v) for kv in given.items() for v in kv])[F.col("component")]), folder)
    ratios = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1)], "split string, ratio double")
    sizes = spark.createDataFrame([(n, 1) for n in "abcdxyz"], "component string, records long")
    for batch in ([("r4", ["a", "b", "c"])], [("r5", ["z"])], [("r6", ["c", "d"])]):
        table = save_table(fill_deficits(update_table(load_table(spark, folder), _links(spark, batch)), sizes, ratios), folder)
        rows = {r["node"]: r for r in table.collect()}
        assert [(rows[n]["component"], rows[n]["split"], rows[n]["status"], rows[n]["conflict"]) for n in "abc"] == [("a", "train", "quarantined", "a"), ("b", "test", "quarantined", "a"), ("c", None, "quarantined", "a")]
        assert rows["x"]["split"] == rows["y"]["split"] == "val" and rows["y"]["component"] == "x"
    assert (rows["d"]["split"], rows["d"]["status"]) == (None, "quarantined") and rows["z"]["split"] is not None and rows["z"]["status"] in ("new", "kept")
    done = settle(table, spark.createDataFrame([("a", "test"), (None, "val")], "conflict string, split string"))
    rows = {r["node"]: r for r in update_table(done, _links(spark, [("r7", ["d", "e"])])).collect()}
    assert {(rows[n]["component"], rows[n]["split"], rows[n]["status"], rows[n]["conflict"]) for n in "abcde"} == {("a", "test", "kept", None)}


def test_an_unfinished_version_does_not_count(spark, tmp_path):
    folder = tmp_path / "table"
    table = save_table(update_table(None, _links(spark, [("r1", ["a"])])), str(folder))
    (folder / "v2").mkdir()
    assert [r["node"] for r in load_table(spark, str(folder)).collect()] == ["a"] and table.columns == ["node", "component", "split", "status", "conflict"]
    save_table(update_table(table, _links(spark, [("r2", ["b"])])), str(folder))
    assert {r["node"] for r in load_table(spark, str(folder)).collect()} == {"a", "b"}


def test_shares_are_reached_and_giants_fit(spark):
    nodes = [f"t{i}" for i in range(2000)]
    table = update_table(None, _links(spark, [(n, [n]) for n in nodes]))
    sizes = spark.createDataFrame([(n, 4000 if n == "t0" else 1 + i % 5) for i, n in enumerate(nodes)], "component string, records long")
    ratios = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1), (None, 0.3)], "split string, ratio double")
    out = fill_deficits(table, sizes, ratios).join(sizes, "component").groupBy("split").agg(F.sum("records").alias("n")).collect()
    got = {r["split"]: r["n"] for r in out}
    total = sum(got.values())
    assert set(got) == {"train", "val", "test"} and all(abs(got[s] / total - r) < 0.01 for s, r in (("train", 0.8), ("val", 0.1), ("test", 0.1)))


def test_torn(spark):
    table = update_table(None, _links(spark, [("r", ["a", "b"]), ("s", ["c"])]))
    seen = spark.createDataFrame([("a", "train"), ("b", "val"), ("c", "val"), ("c", None), ("c", "val")], "node string, split string")
    assert [r["component"] for r in torn(table, seen).collect()] == ["a"]
