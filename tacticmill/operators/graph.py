"""Components, ancestors, coupling and scores over parent-pointer tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tacticmill.session import cut


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) by minimum-label propagation with shortcutting; every round is written, so no lineage grows."""
    und = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).where("x is not null and y is not null").distinct()
    und = cut(und, "cc-und")
    labels = cut(und.groupBy(F.col("x").alias("node")).agg(F.least(F.col("node"), F.min("y")).alias("label")), "cc-label")
    for _ in range(max_rounds):
        near = und.join(labels, und.y == labels.node).groupBy(F.col("x").alias("n")).agg(F.min("label").alias("least"))
        hop = labels.join(near, labels.node == F.col("n")).select("node", F.least("label", "least").alias("label"), F.col("label").alias("old"))
        root = hop.select(F.col("node").alias("r"), F.col("label").alias("up"))
        new = cut(hop.join(root, hop.label == F.col("r")).select("node", F.least("label", "up").alias("label"), "old"), "cc-round")
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError("components did not settle")


def _links_up(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """(n, a): node and parent; a node that is its own parent is a root."""
    return nodes.where(F.col(parent).isNotNull() & (F.col(parent) != F.col(node))).select(F.col(node).alias("n"), F.col(parent).alias("a")).distinct()


def ancestors(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, ancestor, distance) of all proper ancestors, by doubling: 2^i steps after i rounds, until a round adds none.

    The result has a row for each node and ancestor; what needs no such rows uses
    ``nearest`` or ``backpropagated``. Cycles end where they would repeat a node.
    """
    closure = cut(_links_up(nodes, node, parent).withColumn("d", F.lit(1)), "anc")
    span = 1
    while True:
        more = closure.alias("l").join(closure.alias("r"), F.col("l.a") == F.col("r.n")).where(f"l.d = {span}").select("l.n", "r.a", (F.col("l.d") + F.col("r.d")).alias("d")).where("n <> a")
        closure = cut(closure.union(more).groupBy("n", "a").agg(F.min("d").alias("d")), "anc")
        if closure.where(F.col("d") > span).isEmpty():
            return closure.select(F.col("n").alias(node), F.col("a").alias("ancestor"), F.col("d").alias("distance"))
        span *= 2


def nearest(nodes: DataFrame, node: str, parent: str, n: int) -> DataFrame:
    """(node, ancestor, distance) of the n nearest proper ancestors: n joins with the parents, no closure."""
    up = cut(_links_up(nodes, node, parent), "anc-up")
    step = up.withColumn("d", F.lit(1))
    found = step
    for d in range(2, n + 1):
        step = step.join(up.select(F.col("n").alias("a"), F.col("a").alias("next")), "a").select("n", F.col("next").alias("a"), F.lit(d).alias("d")).where("n <> a")
        found = found.union(step)
    return found.groupBy(F.col("n").alias(node), F.col("a").alias("ancestor")).agg(F.min("d").alias("distance"))


def root_path(closure: DataFrame, node: str) -> DataFrame:
    """(node, path): from the root down to the node."""
    g = closure.groupBy(node).agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("o"), F.col("ancestor").cast("string").alias("x")))).alias("p"))
    return g.select(node, F.concat_ws(">", F.array_join("p.x", ">"), F.col(node).cast("string")).alias("path"))


def backpropagated(nodes: DataFrame, node: str, parent: str, reward: str, max_rounds: int = 64) -> DataFrame:
    """(node, visits, value): own reward and those of all descendants.

    Pointer doubling: after round i a node knows the sum over its descendants fewer than 2^i levels
    below and points to the ancestor 2^i levels above, to which it adds its sum. Every round handles
    each node once, and there are as many rounds as the depth has binary digits. A cycle is an error.
    """
    up = F.when(F.col(parent) != F.col(node), F.col(parent))
    state = cut(nodes.select(F.col(node).alias("k"), up.alias("up"), F.lit(1).cast("long").alias("visits"), F.col(reward).cast("double").alias("value")), "back")
    for _ in range(max_rounds):
        below = state.where("up is not null").groupBy(F.col("up").alias("k")).agg(F.sum("visits").alias("more_visits"), F.sum("value").alias("more_value"))
        over = state.select(F.col("k").alias("up"), F.col("up").alias("next"))
        both = state.join(below, "k", "left").join(over, "up", "left")
        state = cut(both.select("k", F.col("next").alias("up"), (F.col("visits") + F.coalesce("more_visits", F.lit(0))).alias("visits"), (F.col("value") + F.coalesce("more_value", F.lit(0.0))).alias("value")), "back")
        if state.where("up is not null").isEmpty():
            return state.select(F.col("k").alias(node), "visits", F.round("value", 6).alias("value"))
    raise RuntimeError("the parents form a cycle")


def registry(states: DataFrame, digest: str, order: list[str], keep: list[str]) -> DataFrame:
    """One row for each state digest: the first occurrence and how often it was visited."""
    w = Window.partitionBy(digest)
    ranked = states.withColumn("_r", F.row_number().over(w.orderBy(*order))).withColumn("visit_count", F.count("*").over(w))
    return ranked.where("_r = 1").select(digest, *keep, "visit_count")


def ucb(value: Column, visits: Column, parent_visits: Column, c: float = 1.414) -> Column:
    return F.when(visits == 0, F.lit(float("inf"))).otherwise(value / visits + c * F.sqrt(F.ln(F.greatest(parent_visits, F.lit(1))) / visits))


def goal_delta(before: Column, after: Column) -> Column:
    """Reward by the change of the number of open goals."""
    goals = lambda s: F.regexp_count(s, F.lit("⊢"))
    done = F.lower(F.trim(after)).isin("no goals", "goals accomplished") | (goals(after) == 0)
    return F.when(done, 1.0).when(goals(after) < goals(before), 0.3).when(goals(after) == goals(before), 0.05).otherwise(-0.1)
