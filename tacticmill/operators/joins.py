"""Lookup joins with fallbacks, resume and prefix replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tacticmill.functions.text import last_segments
from tacticmill.operators.windows import keep_first


def corpus_keys(corpus: DataFrame, name: str, order: list[str]) -> DataFrame:
    """(kind, key, target) of every name: itself, its last segment, its last two; the first name of a key wins."""
    parts = F.size(F.split(name, r"\."))
    kinds = F.array(
        F.struct(F.lit("exact").alias("kind"), F.col(name).alias("key"), F.lit(True).alias("ok")),
        F.struct(F.lit("short").alias("kind"), last_segments(F.col(name), 1).alias("key"), (parts >= 2).alias("ok")),
        F.struct(F.lit("short").alias("kind"), last_segments(F.col(name), 2).alias("key"), (parts >= 3).alias("ok")),
    )
    keys = corpus.where(F.col(name).isNotNull()).select(F.col(name).alias("target"), *[F.col(o) for o in order if o != name], F.explode(kinds).alias("k")).where("k.ok")
    keys = keys.select("target", *[o for o in order if o != name], "k.kind", "k.key")
    return keep_first(keys, ["kind", "key"], [F.col("target") if o == name else F.col(o) for o in order]).select("kind", "key", "target")


def candidate_keys(name: Column) -> Column:
    """(prio, kind, key): the name itself as exact and short key, then ever shorter suffixes as short keys."""
    parts = F.split(name, r"\.")
    suffixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct((i + 1).alias("prio"), F.lit("short").alias("kind"), F.array_join(F.slice(parts, i + 1, F.size(parts) - i), ".").alias("key")))
    return F.concat(F.array(F.struct(F.lit(0).alias("prio"), F.lit("exact").alias("kind"), name.alias("key"))), suffixes)


def resolve_names(cited: DataFrame, cited_name: str, keys: DataFrame) -> DataFrame:
    """(cited_name, target) of each distinct cited name: the first of its candidate keys that the corpus knows."""
    distinct = cited.select(cited_name).where(F.col(cited_name).isNotNull()).distinct()
    tries = distinct.select(cited_name, F.explode(candidate_keys(F.col(cited_name))).alias("c")).select(cited_name, "c.prio", "c.kind", "c.key")
    return tries.join(keys, ["kind", "key"]).groupBy(cited_name).agg(F.min_by("target", "prio").alias("target"))


def resume(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not among the done ones; NULL keys are never done."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def prefix(steps: DataFrame, key: str, step: str, value: str) -> DataFrame:
    """(key, values): one ordered array for each group, from which a prefix is a slice; no range join."""
    g = steps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(step, value))).alias("s"))
    return g.select(key, F.col(f"s.{value}").alias("values"))


def replay_chains(errors: DataFrame, steps: DataFrame, unnamed: str = "_example") -> DataFrame:
    """The errors with (cos_id, step, status): the chain and step that each is replayed to; status is NULL if there is one.

    Errors of a theorem go to its least chain by name. The chains under the name
    ``unnamed`` are different theorems, so their errors, and errors without a usable step
    index, are found by tactic and state. What has no chain keeps its row:
    'no_steps' (unknown theorem), 'step_not_found', or 'ambiguous' (content of several unnamed chains).
    errors: theorem_full_name, step_index, original_tactic, state_before and a key error_id.
    """
    by_name = steps.where(F.col("theorem_full_name") != unnamed).groupBy(F.col("theorem_full_name").alias("_name")).agg(F.min("cos_id").alias("_named"))
    # of equal steps the least chain, in it the last step
    by_content = steps.groupBy(F.col("theorem_full_name").alias("_theorem"), F.col("tactic").alias("_tactic"), F.col("state_before").alias("_state")).agg(
        F.countDistinct("cos_id").alias("_chains"), F.max(F.struct((-F.col("cos_id")).alias("c"), F.col("step_index").alias("i"))).alias("_at")
    )
    example = F.coalesce(F.col("theorem_full_name") == unnamed, F.lit(False))
    usable = F.coalesce(F.col("step_index") >= 0, F.lit(False))
    # the unnamed share no key here, so their number makes no hot one
    e = errors.withColumn("_key", F.when(example, F.concat(F.lit("\n"), F.col("error_id").cast("string"))).otherwise(F.col("theorem_full_name")))
    j = e.join(by_name, F.col("_key") == F.col("_name"), "left").join(
        by_content, (F.col("theorem_full_name") == F.col("_theorem")) & (F.col("original_tactic") == F.col("_tactic")) & (F.col("state_before") == F.col("_state")), "left"
    )
    several = example & (F.col("_chains") > 1)
    cos_id = F.when(several, F.lit(None)).when(example | ~usable, -F.col("_at.c")).otherwise(F.col("_named"))
    status = F.when(several, "ambiguous").when(~example & F.col("_named").isNull(), "no_steps").when(cos_id.isNull(), "step_not_found")
    return j.select(*errors.columns, cos_id.alias("cos_id"), F.when(usable, F.col("step_index")).otherwise(F.col("_at.i")).alias("step"), status.alias("status"))


def interval_lookup(points: DataFrame, point: str, ranges: DataFrame, lo: str, hi: str, group: str, order: list[str], width: int) -> DataFrame:
    """First closed range that covers each point of the same group.

    Both sides are cut into bins of the width, so the join is on (group, bin)
    and only checks the bounds inside it.
    """
    r = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    p = points.withColumn("_bin", F.floor(F.col(point) / width))
    hit = p.join(r, [group, "_bin"]).where(F.col(point).between(F.col(lo), F.col(hi))).drop("_bin")
    return keep_first(hit, [group, point], order)


def coupling(df: DataFrame, node: str, shared: str, free: Column) -> DataFrame:
    """(node, shared, leader, n_links): nodes coupled through a value for which ``free`` holds.

    Each shared value is a class named by its least node; a node links to the
    size of the class less one. Pairs inside a class are not written out.
    """
    rows = df.where(free).select(F.col(shared), F.col(node)).distinct()
    classes = rows.groupBy(shared).agg(F.min(node).alias("leader"), (F.count("*") - 1).alias("n_links")).where("n_links > 0")
    return rows.join(classes, shared).select(node, shared, "leader", "n_links")


def latest(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Last-wins side of a lookup."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() if isinstance(o, str) else o for o in order])
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
