"""Operators and queries give every row they owe."""

from pyspark.sql import functions as F

from tacticmill.operators import joins as J
from tacticmill.sources import kernel

ERROR = "error_id long, theorem_full_name string, step_index int, original_tactic string, state_before string"


def test_every_error_gets_a_chain_or_a_status(spark):
    chains = [(1, "a.b", ["x", "y"]), (2, "a.b", ["x", "z"]), (5, "_example", ["p", "q", "q"]), (6, "_example", ["p", "r"])]
    steps = spark.createDataFrame([(c, t, i, v, f"state {i}" if t == "a.b" or i == 0 else f"state {c}") for c, t, vs in chains for i, v in enumerate(vs)], "cos_id long, theorem_full_name string, step_index int, tactic string, state_before string")
    errors = [
        (1, "a.b", 1, "y", "state 1"), (2, "_example", 1, "r", "state 6"), (3, "_example", 0, "p", "state 0"), (4, "_example", 1, "r", "other"),
        (5, "unknown", 0, "x", "state 0"), (6, "a.b", -1, "z", "state 1"), (7, "_example", None, "q", "state 5"), (8, None, 1, "x", "state 0"), (9, "a.b", None, None, None),
    ]
    got = {r["error_id"]: (r["cos_id"], r["step"], r["status"]) for r in J.replay_chains(spark.createDataFrame(errors, ERROR), steps).collect()}
    assert got == {
        1: (1, 1, None), 2: (6, 1, None), 3: (None, 0, "ambiguous"), 4: (None, 1, "step_not_found"), 5: (None, 0, "no_steps"),
        6: (2, 1, None), 7: (5, 2, None), 8: (None, 1, "no_steps"), 9: (None, None, "step_not_found"),
    }


def test_a_given_status_is_kept(spark):
    df = spark.createDataFrame([(1, "g", None, "x", "ambiguous"), (2, "g", [], "", None)], "error_id long, goal string, replay array<string>, error_tactic string, status string")
    got = {r["error_id"]: r["verification_status"] for r in kernel.verify(df, kernel.StandInKernel).collect()}
    assert got == {1: "ambiguous", 2: "verified"}


def test_all_errors_are_replayed_and_verified(spark, sf_dir):
    from tacticmill.plans.registry import queries

    wanted = spark.read.parquet(f"{sf_dir}/error_records.parquet").select("error_id").distinct().count()
    for name in ("error_replays", "verified_errors"):
        out = queries()[name](spark, sf_dir)
        assert out.count() == out.select("error_id").distinct().count() == wanted


def test_every_pair_is_a_sample_and_theorems_stay_whole(spark, sf_dir):
    from tacticmill.functions.text import identifiers
    from tacticmill.plans.base import records
    from tacticmill.plans.join_plans import _premises
    from tacticmill.plans.registry import queries

    cited, resolved = _premises(spark, sf_dir)
    pairs = cited.where(F.size(identifiers(F.col("state_before"))) > 0).join(resolved, "cited").select(F.concat_ws("-", "cos_id", "step_index").alias("qid"), F.col("target").alias("positive")).distinct()
    got = queries()["contrastive_samples"](spark, sf_dir).cache()
    assert got.count() == pairs.count() == pairs.join(got, ["qid", "positive"]).count()
    assert all(r["positive"] not in r["negatives"].split(",") for r in got.collect())
    theorems = records(spark, sf_dir, "cos_records", "theorem_full_name")
    by = got.join(theorems, F.split("qid", "-")[0].cast("long") == F.col("cos_id")).groupBy("theorem_full_name").agg(F.countDistinct("split").alias("n"))
    assert by.where("n > 1").count() == 0
