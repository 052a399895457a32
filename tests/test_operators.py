"""Operators on small tables: order, splits, fallbacks, trees, resume, kernels, retrieval."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tacticmill.operators import augment as A
from tacticmill.operators import filters as P
from tacticmill.operators import graph as G
from tacticmill.operators import joins as J
from tacticmill.operators import retrieval as V
from tacticmill.operators import windows as W
from tacticmill.sources import io, kernel


def test_keep_first_is_planned_with_a_group_limit(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    first = W.keep_first(df, ["k"], ["id"])
    assert "WindowGroupLimit" in first._jdf.queryExecution().toString()
    assert sorted(r["id"] for r in first.collect()) == list(range(7))


@pytest.mark.parametrize("total, batches", [(119, 6), (7, 3), (6, 6), (5, 6), (1, 1)])
def test_slices(spark, total, batches):
    got = W.slices(spark.range(total), ["id"], batches).orderBy("id").collect()
    size, extra = divmod(total, batches)
    assert [r["batch"] for r in got] == [b for b in range(batches) for _ in range(size + (b < extra))]


def test_ratio_split_counts_and_whole_groups(spark):
    rows = spark.range(60).select((F.col("id") % 20).cast("string").alias("t"))
    parts = W.ratio_split(rows, "t", {"train": 0.8, "val": 0.1, "test": 0.1}).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in parts} == {"train": 16, "val": 2, "test": 2}


def test_contiguity(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("a", 1), ("b", 1), ("c", 0), ("c", 2), ("d", None)], "k string, s int")
    assert {r["k"]: r["status"] for r in W.contiguity(df, "k", "s").collect()} == {"a": "ok", "b": "incomplete", "c": "gap", "d": "incomplete"}


def test_nearest_rank(spark):
    df = spark.createDataFrame([(v,) for v in [5, 1, 9, 3, 7, None]], "v int")
    assert tuple(W.nearest_rank(df, "v", {"p0": 0.0, "p50": 0.5, "p90": 0.9}).first()) == (1, 5, 9)


def test_resolution_order(spark):
    corpus = spark.createDataFrame([("A.B.c",), ("X.Y.c",), ("A.d",), (None,)], "name string")
    cited = spark.createDataFrame([("A.B.c",), ("c",), ("Y.c",), ("Q.d",), ("nope",), (None,)], "n string")
    got = {r["n"]: r["target"] for r in J.resolve_names(cited, "n", J.corpus_keys(corpus, "name", ["name"])).collect()}
    assert got == {"A.B.c": "A.B.c", "c": "A.B.c", "Y.c": "X.Y.c", "Q.d": "A.d"}


def test_components_and_deep_ancestors(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a int, b int")
    got = {r["node"]: r["component"] for r in G.connected_components(edges).collect()}
    assert {got[i] for i in range(301)} == {0} and got[1001] == 1000
    nodes = spark.createDataFrame([(0, None), (7, 7), *[(i, i - 1) for i in range(1, 7)]], "n int, p int")
    anc = {(r["n"], r["ancestor"]): r["distance"] for r in G.ancestors(nodes, "n", "p").collect()}
    assert anc[(6, 0)] == 6 and len(anc) == 21
    chain = spark.createDataFrame([(0, None), *[(i, i - 1) for i in range(1, 151)]], "n int, p int")
    assert G.ancestors(chain, "n", "p").where("n = 150").count() == 150


def test_rewards(spark):
    df = spark.createDataFrame([("⊢ a", "no goals"), ("⊢ a\n⊢ b", "⊢ b"), ("⊢ a", "⊢ b"), ("⊢ a", "⊢ b\n⊢ c")], "b string, a string")
    assert [r[0] for r in df.select(G.goal_delta(F.col("b"), F.col("a"))).collect()] == [1.0, 0.3, 0.05, -0.1]


def test_injection_properties(spark):
    steps = spark.createDataFrame([("k", 0, "rw [a, b] at h"), ("k", 1, "omega"), ("k", 2, ""), ("k", 3, None)], "k string, step int, t string")
    rows = A.inject(steps, ["k", "step"], "t", "step").collect()
    assert sum(r["step"] == 0 for r in rows) <= 4 and sum(r["step"] == 1 for r in rows) <= 1
    assert all(r["error_tactic"] and r["error_tactic"] != r["t"] for r in rows) and not any(r["step"] > 1 for r in rows)
    assert rows == A.inject(steps, ["k", "step"], "t", "step").collect()


def test_quotas():
    assert A.quotas(101, {"a": 0.5, "b": 0.3, "c": 0.2}) == {"a": 50, "b": 30, "c": 21}


def test_consistency_rules(spark):
    rows = [("use `rw [a_b]` here", "rw [a_b]", "x", "wrong_tactic", True), ("about Foo.bar", "exact Foo.bar h", "x", "wrong_tactic", True), ("nothing", "exact Foo.bar", "simp", "wrong_tactic", False), ("simp is wrong", "exact Foo.bar", "simp", "wrong_tactic", True), ("any", "", "e", "t", True), ("any", None, None, None, True), (None, "a b", "c", "d", False)]
    df = spark.createDataFrame(rows, "r string, o string, e string, t string, want boolean")
    got = df.select(P.consistent(*[F.col(c) for c in "roet"]).alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_dense_topk_equals_brute_force_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    monkeypatch.setattr(V, "VECTOR_BLOCK", 11)
    x = np.random.default_rng(1).normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "n int, v array<double>")
    got = V.dense_topk(df.where("n % 3 = 0").select(F.col("n").alias("q"), "v"), "q", df, "n", "v", 5, exclude_self=True).collect()
    scores = np.round(x @ x.T, 6)
    for q in range(0, 60, 3):
        want = sorted((i for i in range(60) if i != q), key=lambda i: (-scores[q, i], i))[:5]
        assert [r["n"] for r in sorted((r for r in got if r["q"] == q), key=lambda r: r["rank"])] == want


def test_symbolic_topk_equals_brute_force_in_blocks(spark, monkeypatch):
    import random

    monkeypatch.setattr(V, "QUERY_BLOCK", 6)
    monkeypatch.setattr(V, "VECTOR_BLOCK", 9)
    rng = random.Random(8)
    # every document holds one token, a third holds another
    docs = [(f"D.{i:02}", " ".join(["common", *(["third"] if i % 3 == 0 else []), *rng.sample([f"t{j}" for j in range(12)], 4)])) for i in range(50)] + [("D.none", ""), ("D.null", None), (None, "common")]
    asked = [(q, " ".join(["common", *rng.sample([f"t{j}" for j in range(14)], 5)])) for q in range(20)] + [(99, None), (98, "unseen")]
    got = V.symbolic_topk(spark.createDataFrame(asked, "q int, text string"), "q", "text", spark.createDataFrame(docs, "n string, body string"), "n", "body", 7).collect()
    for q, text in asked:
        tokens = set((text or "").split())
        scored = sorted((-len(tokens & set(b.split())), n, len(tokens | set(b.split()))) for n, b in docs if n and b and tokens & set(b.split()))[:7]
        assert [(r["n"], r["overlap"], r["score"]) for r in sorted((r for r in got if r["q"] == q), key=lambda r: r["rank"])] == [(n, -o, round(-o / u, 6)) for o, n, u in scored]
    assert V.symbolic_topk(spark.createDataFrame(asked, "q int, text string").limit(0), "q", "text", spark.createDataFrame(docs, "n string, body string"), "n", "body", 7).collect() == []


def test_ties_at_the_last_place(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(6)], "n int, v array<double>")
    got = V.dense_topk(df.where("n = 0").select(F.col("n").alias("q"), "v"), "q", df, "n", "v", 3).collect()
    assert sorted(r["n"] for r in got) == [0, 1, 2]


def test_cell_index_recall(spark, sf_dir):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("n"), F.col("embedding").alias("v"))
    q = v.where("n % 10 = 0").select(F.col("n").alias("q"), "v")
    centres, index = V.build_cell_index(v, "n", "v")
    assert index.count() == v.count()
    assert V.recall(V.cell_search(q, "q", "v", centres, index, "n", 10, probe=10), V.dense_topk(q, "q", v, "n", "v", 10), "q", "n").first()["recall"] >= 0.9


def test_index_is_written_read_and_switched(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "VECTOR_BLOCK", 50)
    monkeypatch.setattr(V, "QUERY_BLOCK", 9)
    monkeypatch.setattr(V, "STRIPE", 4)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20, 8))[rng.integers(0, 20, 900)] + 0.05 * rng.normal(size=(900, 8))
    x[:300] = x[0] + 0.001 * rng.normal(size=(300, 8))  # a third in one place
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "n long, v array<double>")
    q = v.where("n % 20 = 0").select(F.col("n").alias("q"), "v")
    truth = V.dense_topk(q, "q", v, "n", "v", 10)
    flat = V.build_index(v, "n", "v", str(tmp_path / "flat"))
    assert len(flat.centres) == 1 and V.search(q, "q", "v", flat, 10).exceptAll(truth).isEmpty()
    V.build_index(v, "n", "v", str(tmp_path / "cells"), flat_below=0)
    cells = V.read_index(spark, str(tmp_path / "cells"), "n")
    assert len(cells.centres) == 900 // 39 and cells.table.count() == 900
    assert V.recall(V.search(q, "q", "v", cells, 10), truth, "q", "n").first()["recall"] >= 0.9
    assert [V.effective_cells(n) for n in (10, 10_000, 10**6, 10**12)] == [1, 256, 4000, 4096]
    assert V.build_index(v.limit(0), "n", "v", str(tmp_path / "none")).table.count() == 0


def test_backpropagation_and_nearest_ancestors(spark):
    import random

    rng = random.Random(2)
    parent = {0: None, 500: 500} | {i: rng.randrange(i) for i in range(1, 200)} | {i: i - 1 for i in range(501, 900)}
    up = {n: p for n, p in parent.items() if p is not None and p != n}
    nodes = spark.createDataFrame([(n, p, float(n % 7)) for n, p in parent.items()], "n int, p int, r double")
    want = {n: [0, 0.0] for n in parent}
    near = set()
    for n in parent:
        at, d = n, 0
        while at is not None:
            want[at][0] += 1
            want[at][1] += n % 7
            if 0 < d <= 3:
                near.add((n, at, d))
            at, d = up.get(at), d + 1
    assert {r["n"]: [r["visits"], r["value"]] for r in G.backpropagated(nodes, "n", "p", "r").collect()} == want
    assert {tuple(r) for r in G.nearest(nodes, "n", "p", 3).collect()} == near
    with pytest.raises(RuntimeError):
        G.backpropagated(spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "n int, p int, r double"), "n", "p", "r", max_rounds=5)


def test_deep_chains_have_all_ancestors(spark):
    chain = spark.createDataFrame([(0, None), *[(i, i - 1) for i in range(1, 5001)]], "n int, p int")
    assert G.backpropagated(chain.withColumn("r", F.lit(1.0)), "n", "p", "r").where("n = 0").first()["visits"] == 5001
    assert G.ancestors(chain.where("n <= 700"), "n", "p").where("n = 700").count() == 700


def test_json_sources(spark, tmp_path):
    lines, array = tmp_path / "a.jsonl", tmp_path / "b.json"
    lines.write_text('{"a": 1}\n\n{"a": 2}\nnot json\n')
    array.write_text('[{"a": 1}, {"a": 2}]')
    tolerant = io.read_json_lines(spark, str(lines), "a int", strict=False).cache()
    assert tolerant.where("_corrupt_record is null and a is not null").count() == 2 and tolerant.where("_corrupt_record is not null").count() == 1
    with pytest.raises(Exception):
        io.read_json_lines(spark, str(lines), "a int").collect()
    assert [r["a"] for r in io.read_json(spark, str(array), "a int").orderBy("a").collect()] == [1, 2]
    assert io.line_count(spark, str(lines)) == 4


def test_file_scan_prunes_directories(spark, tmp_path):
    for p in ("src/A.lean", "test/B.lean", "src/deep/C.lean", "src/x.txt"):
        os.makedirs((tmp_path / p).parent, exist_ok=True)
        (tmp_path / p).write_text("theorem t (x : ℕ) : x = x := by\n  rfl\n")
    files = io.scan_files(spark, str(tmp_path))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in files.collect()) == ["A.lean", "C.lean"]
    got = io.theorem_statements(files).first()
    assert (got["name"], got["arguments"], got["type"]) == ("t", "(x : ℕ)", "x = x")


def test_resume_and_patch(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.range(10)
    io.run_resumable(df.where("id < 4"), ["id"], out, lambda x: x, 0)
    assert io.run_resumable(df, ["id"], out, lambda x: x, 2).count() == 10
    assert [r["id"] for r in io.missing_batches(spark, out, 4).orderBy("id").collect()] == [1, 3]
    df.write.parquet(str(tmp_path / "t"))
    assert io.patched(spark.read.parquet(str(tmp_path / "t")), str(tmp_path / "t"), lambda x: x.withColumn("b", F.lit(1))).columns == ["id", "b"]
    with pytest.raises(ValueError):
        io.patched(spark.read.parquet(str(tmp_path / "t")), str(tmp_path / "t"), lambda x: x.where("id > 3"))


def test_run_state():
    state, ran = io.RunState(), []

    def fails():
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        io.run_pipeline(state, {"a": lambda: ran.append("a") or "pa", "b": fails, "c": lambda: ran.append("c") or ""})
    again = io.RunState.from_json(state.to_json())
    assert ran == ["a"] and again.steps["b"]["status"] == "failed" and json.loads(state.to_json())["a"]["output_path"] == "pa"
    assert again.remaining(["a", "b", "c"]) == ["b", "c"] and again.remaining(["a", "b", "c"], "c") == ["c"]
    assert io.run_pipeline(again, {"a": fails, "b": fails}, disabled=frozenset({"b"}), dry_run=True) == []


def test_batched_service_retries(spark):
    def call(rows):
        import os
        import random

        if random.random() < 0.3 and not os.environ.get("NEVER"):
            raise OSError("busy")
        return [{"id": r["id"], "n": len(rows)} for r in rows]

    got = io.in_batches(spark.range(20).coalesce(1), call, "id long, n int", size=8, attempts=12).collect()
    assert sorted(r["id"] for r in got) == list(range(20)) and {r["n"] for r in got} == {8, 4}


def test_kernel_statuses(spark):
    class Fake:
        def start(self, goal):
            if not goal:
                raise ValueError("empty")
            return goal

        def apply(self, state, tactic):
            if tactic.startswith("bad"):
                raise ValueError(tactic)
            return state + tactic

    rows = [(1, "g", ["a"], "bad"), (2, "g", ["a"], "ok"), (3, "g", ["a", "bad1"], "x"), (4, "", [], "x")]
    df = spark.createDataFrame(rows, "error_id long, goal string, replay array<string>, error_tactic string")
    got = {r["error_id"]: r["verification_status"] for r in kernel.verify(df, Fake).collect()}
    assert got == {1: "verified", 2: "error_tactic_succeeded", 3: "replay_failed_at_step_1", 4: "goal_start_failed"}


def test_observed_counts(spark):
    df, seen = io.observed(spark.range(10), small=F.col("id") < 3)
    df.collect()
    assert seen.get == {"rows": 10, "small": 3}


def test_search_and_repair(spark):
    from tacticmill.operators import search as H

    class Fake:
        def start(self, goal):
            return goal

        def apply(self, state, tactic):
            if tactic == "bad":
                raise ValueError("no")
            return state + tactic

    assert H.search_one("g", ["bad", "a", "b"], Fake(), lambda s: s.endswith("ab"))[::2] == (True, ["a", "b"])
    assert H.search_one("g", ["bad"], Fake(), lambda s: False) == (False, 1, [])
    assert H.repair_one("s", "bad", lambda t, r: ["bad", "ok"] if r == "ESR" else ["bad"], Fake()) == (True, "ESR", "ok", 3)
    assert H.repair_one("s", "bad", lambda t, r: ["bad"], Fake()) == (False, "ESR", "", 2)


def test_shell_entry(capsys):
    from tacticmill import cli

    assert cli.main(["--input", "x", "--list"]) == 0 and "rrf_fused" in capsys.readouterr().out
    assert cli.main(["--input", "x", "--step", "corpus_gate", "--step", "top_modules", "--resume-from", "top_modules", "--dry-run"]) == 0
    assert capsys.readouterr().out.split() == ["top_modules"]


def test_hints_name_what_was_done(spark):
    rows = [("k", i, t) for i, t in enumerate(["simp [a]", "rw [x] at h", "exact foo bar baz", "omega", "linarith h1 h2", "intro x y", "", None] * 6)]
    steps = spark.createDataFrame([(k, i, t, 0) for k, i, t in rows], "k string, i int, t string, step int")
    out = A.inject_with_hints(steps, ["k", "i"], "t", "step").collect()
    assert {r["error_type"] for r in out} == set(A.ERROR_TYPES) and all(r["repair_hint"] for r in out)
    for r in out:
        head, bad = r["t"].split()[0], r["error_tactic"].split()[0]
        if r["error_type"] == "tactic_typo":
            assert r["repair_hint"] == f"typo: '{bad}' should be '{head}'" and (head not in A.TYPOS or bad in A.TYPOS[head])
        elif r["error_type"] == "wrong_tactic":
            assert r["repair_hint"] == f"wrong tactic: should use '{head}' instead of '{bad}'"
        elif r["error_type"] == "missing_step":
            assert r["repair_hint"] == f"missing step: used '{r['error_tactic']}' placeholder, should be '{r['t']}'"
        elif "was removed" in r["repair_hint"]:
            n, word = int(r["repair_hint"].split()[3]), r["repair_hint"].split("'")[1]
            args = r["t"].split()[1:]
            assert args[n - 1] == word and r["error_tactic"].split()[1:] == args[: n - 1] + args[n:]
        elif "inserted" in r["repair_hint"]:
            n = int(r["repair_hint"].split()[-1])
            assert r["error_tactic"].split()[n] == "h"


def test_repair_follows_the_message():
    from tacticmill.operators import search as H

    class Told:
        def __init__(self, message):
            self.message, self.seen = message, []

        def start(self, goal):
            return goal

        def apply(self, state, tactic):
            self.seen.append((state, tactic))
            if tactic != "good":
                raise ValueError(self.message)
            return state + "."

    repairs = lambda t, route: ["x", "y", "z", "good"] if route == "ETR" else ["good"]
    told = Told("failed to synthesize")
    assert H.repair_one("s", "bad", repairs, told, above="up") == (True, "ESR", "good", 1) and told.seen[-1] == ("up", "good")
    told = Told("tactic 'bad' failed")
    # the third failure gives the tactic up
    assert H.repair_one("s", "bad", repairs, told, above="up") == (True, "ESR", "good", 3) and told.seen[-1] == ("up", "good")
    assert H.repair_one("s", "good", repairs, told) == (True, "none", "good", 0)
    assert H.repair_one("s", "bad", lambda t, r: ["good"], Told("odd")) == (True, "ETR", "good", 1)


def test_two_level_search_has_its_budgets():
    from tacticmill.operators import search as H

    class Path:
        def __init__(self):
            self.calls = 0

        def start(self, goal):
            if not goal:
                raise ValueError("nothing")
            return ""

        def apply(self, state, tactic):
            self.calls += 1
            if tactic == "bad" or len(state) > 6:
                raise ValueError("tactic 'bad' failed")
            return state + tactic

    none = lambda t, r: []
    done, nodes, path = H.two_level_search("g", ["bad", "a", "b"], Path(), lambda s: s == "aba", none, outer=40, inner=3)
    assert done and path == ["a", "b", "a"] and nodes <= 40
    assert H.two_level_search("", ["a"], Path(), bool, none) == (False, 0, [])
    kernel_ = Path()
    assert H.two_level_search("g", ["a", "b"], kernel_, lambda s: False, none, outer=2, inner=1)[0] is False and kernel_.calls <= 2
    repaired = H.two_level_search("g", ["bad"], Path(), lambda s: s == "a", lambda t, r: ["a"], outer=2, inner=1)
    assert repaired == (True, 2, ["a"])


def test_service_is_paced_bounded_and_retried(spark):
    import threading
    import time

    pauses = []
    calls = iter([1, 1, 0])

    def flaky():
        if next(calls):
            raise OSError
        return "ok"

    assert io.with_retries(flaky, 3, base=1.0, longest=1.5, pause=pauses.append) == "ok"
    assert 0.5 <= pauses[0] <= 1.5 and 0.75 <= pauses[1] <= 2.25
    with pytest.raises(OSError):
        io.with_retries(lambda: (_ for _ in ()).throw(OSError()), 2, pause=pauses.append)
    pace, began = io.Pace(50), time.monotonic()
    threads = [threading.Thread(target=pace) for _ in range(11)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert time.monotonic() - began >= 0.19

    def call(rows):
        return [{"id": r["id"], "n": len(rows)} for r in rows]

    got = io.in_batches(spark.range(50).coalesce(1), call, "id long, n int", size=7, concurrency=4, rate=1000).collect()
    assert [r["id"] for r in got] == list(range(50)) and sorted({r["n"] for r in got}) == [1, 7]


def test_configuration_and_environment(tmp_path):
    (tmp_path / "a.json").write_text('{"a": {"b": [1, 2]}}')
    (tmp_path / "b.yaml").write_text("a:\n  b: [1, 2]\n")
    (tmp_path / "c.json").write_text("")
    assert io.load_config(str(tmp_path / "a.json")) == {"a": {"b": [1, 2]}} and io.load_config(str(tmp_path / "c.json")) == {}
    pytest.importorskip("yaml")
    assert io.load_config(str(tmp_path / "b.yaml")) == {"a": {"b": [1, 2]}}
    found = io.check_environment({"here": str(tmp_path), "gone": str(tmp_path / "x")}, ["json", "no_such_module"])
    assert found == [("here", "path", True), ("gone", "path", False), ("json", "module", True), ("no_such_module", "module", False)]


def test_written_tables_can_be_cleared(spark):
    from tacticmill import session

    df = session.cut(spark.range(5), "clear")
    path = session.written(spark)[-1]
    assert "clear-" in path and df.count() == 5
    session.clear_written(spark, [path])
    assert path not in session.written(spark) and not os.path.exists(path.removeprefix("file:"))


def test_shell_jobs_configuration_and_check(tmp_path, capsys, sf_dir):
    from tacticmill import cli
    from tacticmill.plans import registry

    assert {s for steps in cli.JOBS.values() for s in steps} <= set(registry.queries())
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"input": sf_dir, "job": ["corpus"], "step": ["top_modules"]}))
    assert cli.main(["--config", str(config), "--dry-run"]) == 0
    assert capsys.readouterr().out.split() == [*cli.JOBS["corpus"], "top_modules"]
    assert cli.main(["--config", str(config), "--check"]) == 0 and cli.main(["--input", str(tmp_path / "none"), "--check"]) == 1
    assert "missing\tpath\tinput" in capsys.readouterr().out
    config.write_text('{"odd": 1}')
    for bad in (["--config", str(config)], []):
        with pytest.raises(SystemExit):
            cli.main(bad)
