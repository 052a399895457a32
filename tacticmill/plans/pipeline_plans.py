"""Pipelines and searches, and the row forms they hand on."""

from __future__ import annotations

from pyspark.sql import functions as F

from tacticmill.functions import text as X
from tacticmill.operators import augment as A
from tacticmill.operators import joins as J
from tacticmill.operators import pipeline as L
from tacticmill.operators import search as H
from tacticmill.plans.base import ERR, FIRST, STEPS, query, records, steps, table
from tacticmill.plans.chain_plans import _INDICES
from tacticmill.session import cut
from tacticmill.sources import kernel


@query(f"WITH {ERR}, a AS (SELECT * FROM err ORDER BY error_id LIMIT 500) SELECT error_id FROM a WHERE coalesce(state_before, '') <> '' AND coalesce(original_tactic, '') NOT IN ('', 'sorry')")
def sft_rows(spark, d):
    """The cap counts rows read, so it comes before the filter: the operator is the cap."""
    first = records(spark, d, "error_records", "state_before", "original_tactic").orderBy("error_id").limit(500)
    return first.where((X.text(F.col("state_before")) != "") & ~X.text(F.col("original_tactic")).isin("", "sorry")).select("error_id")


@query(
    f"""WITH {ERR}, p AS (SELECT error_id, theorem_full_name AS n, string_split(theorem_full_name, '.') AS s, theorem_name AS t FROM err WHERE theorem_full_name IS NOT NULL),
c AS (SELECT error_id, 1 AS prio, n AS candidate FROM p UNION ALL SELECT error_id, 2, array_to_string(list_filter(s, lambda x, i: i = 1 OR x <> s[i - 1]), '.') FROM p UNION ALL SELECT error_id, 3, t FROM p),
k AS (SELECT DISTINCT theorem_full_name AS candidate FROM cos_records UNION SELECT DISTINCT theorem_name FROM cos_records)
SELECT error_id, arg_min(candidate, prio) AS found, min(prio) AS prio FROM c JOIN k USING (candidate) GROUP BY error_id"""
)
def candidate_names(spark, d):
    """The first of (full name, name without doubled segments, short name) that the chains know."""
    e = records(spark, d, "error_records", "theorem_full_name", "theorem_name").where("theorem_full_name is not null")
    tries = F.array(*[F.struct(F.lit(i).alias("prio"), c.alias("candidate")) for i, c in enumerate((F.col("theorem_full_name"), X.without_repeats(F.col("theorem_full_name")), F.col("theorem_name")), 1)])
    c = table(spark, d, "cos_records")
    known = c.select(F.col("theorem_full_name").alias("candidate")).union(c.select("theorem_name")).distinct()
    rows = e.select("error_id", F.explode(tries).alias("t")).select("error_id", "t.prio", "t.candidate")
    return rows.join(known, "candidate").groupBy("error_id").agg(F.min_by("candidate", "prio").alias("found"), F.min("prio").alias("prio"))


@query(f"WITH {STEPS}, a AS (SELECT cos_id, step_index, string_split(state_before, chr(10)) AS l FROM steps WHERE state_before IS NOT NULL) SELECT cos_id, step_index, md5(array_to_string(list_filter(l, lambda x: NOT starts_with(x, '⊢') AND NOT starts_with(x, 'case ')), '; ') || ' ⊢ ' || array_to_string(list_transform(list_filter(l, lambda x: starts_with(x, '⊢')), lambda x: trim(substr(x, 2))), ' ; ')) AS goal FROM a")
def goal_format(spark, d):
    """A state as one line: hypotheses, turnstile, targets."""
    s = steps(spark, d).where("state_before is not null").withColumn("l", F.split("state_before", "\n"))
    hyps = F.array_join(F.filter("l", lambda x: ~x.startswith("⊢") & ~x.startswith("case ")), "; ")
    targets = F.array_join(F.transform(F.filter("l", lambda x: x.startswith("⊢")), lambda x: F.trim(F.substring(x, 2, 1 << 30))), " ; ")
    return s.select("cos_id", "step_index", F.md5(F.concat(hyps, F.lit(" ⊢ "), targets)).alias("goal"))


_NOTES = [("omega", "linear arithmetic decides it"), ("rw", "rewrite with the equation"), ("exact", "the term has the type"), ("apply", "reduce to the premises"), ("intro", "name the hypothesis")]


@query(f"""WITH {STEPS}, n(head, note) AS (VALUES {', '.join(f"('{h}', '{t}')" for h, t in _NOTES)}) SELECT cos_id, step_index, coalesce(note, 'advance the goal') AS thought FROM steps LEFT JOIN n ON n.head = {FIRST.format('tactic')}""")
def thought_templates(spark, d):
    """A note by the head of the tactic, with a default. The notes are a parameter table."""
    n = spark.createDataFrame(_NOTES, "head string, note string")
    s = steps(spark, d).withColumn("head", X.first_token(F.col("tactic")))
    return s.join(F.broadcast(n), "head", "left").select("cos_id", "step_index", F.coalesce("note", F.lit("advance the goal")).alias("thought"))


@query()
def correction_pairs(spark, d):
    """A faulty form of every step's tactic beside it."""
    s = steps(spark, d).where("coalesce(tactic, '') <> ''").withColumn("head", X.first_token(F.col("tactic"))).withColumn("h", X.hash_number(F.concat_ws("|", "cos_id", "step_index")))
    return s.select("cos_id", "step_index", "tactic", A.correction_pair(F.col("tactic"), F.col("head"), F.col("h")).alias("faulty")).where("faulty <> tactic")


@query(
    _INDICES
    + """, ok AS (SELECT e.cos_id, idx, e.chain FROM e WHERE n BETWEEN 3 AND 200 AND len(list_filter(e.chain, lambda s: contains(s.tactic, 'sorry') OR contains(s.tactic, 'native_decide'))) = 0),
f AS (SELECT cos_id, CAST(j - 1 AS INTEGER) AS step_index, CAST(idx[j] AS INTEGER) AS full_index, chain[idx[j] + 1] AS s FROM (SELECT cos_id, idx, chain, unnest(range(1, least(len(idx), 50) + 1)) AS j FROM ok))
SELECT cos_id, step_index, full_index, md5(s.tactic) AS tactic FROM f WHERE coalesce(s.state_before, '') <> '' AND coalesce(s.tactic, '') <> '' AND NOT starts_with(s.state_before, '[state_') AND NOT (coalesce(s.state_before, '') = coalesce(s.state_after, '') AND s.tactic NOT IN ('skip', 'rfl'))"""
)
def flat_steps(spark, d):
    f = L.flat_steps(records(spark, d, "cos_records", "theorem_full_name", "full_cos_chain"))
    return f.select("cos_id", "step_index", "full_index", F.md5("tactic").alias("tactic"))


@query()
def dataset_pipeline(spark, d):
    """Sound steps and their faults, distinct, with whole theorems to a split."""
    return L.dataset(records(spark, d, "cos_records", "theorem_full_name", "full_cos_chain"), {"train": 0.9, "val": 0.05, "test": 0.05})


def _theorems(spark, d):
    s = steps(spark, d)
    goals = s.where("step_index = 0").select("cos_id", X.text(F.col("state_before")).alias("goal"))
    return J.prefix(s, "cos_id", "step_index", "tactic").join(goals, "cos_id").select(F.col("cos_id").cast("string").alias("theorem"), "goal", F.col("values").alias("tactics"))


def _search(theorems):
    return H.tree_search(theorems, lambda: kernel.StandInKernel(0.3), lambda state: state.startswith("0"), 64)


@query()
def tree_search(spark, d):
    """Tree search over each chain's own tactics against the stand-in kernel."""
    return _search(_theorems(spark, d))


def _repairs(tactic: str, route: str) -> list[str]:
    return [" ".join(tactic.split()), "simp", "omega"] if route == "ETR" else ["ring", "tauto", "norm_num"]


@query()
def state_search(spark, d):
    """Two-level search with repair over each chain's own tactics against the stand-in kernel."""
    return H.state_search(_theorems(spark, d), lambda: kernel.StandInKernel(0.3), lambda state: state.startswith("0"), _repairs)


@query()
def repair_loop(spark, d):
    """Faulty tactics repaired against the stand-in kernel by the route that its message calls for."""
    e = records(spark, d, "error_records", "state_before", "error_tactic").select("error_id", X.text(F.col("state_before")).alias("state"), "error_tactic")
    return H.repair(e, _repairs, lambda: kernel.StandInKernel(0.6))


@query()
def self_play(spark, d):
    """Two rounds of sampling, searching and mixing."""
    t = cut(_theorems(spark, d), "theorems")
    base = t.select("theorem", F.array_join("tactics", ";").alias("tactics"))
    return H.self_play(t, base, _search)
