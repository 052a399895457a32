"""Splits that keep related records together.

``components`` labels the connected parts of a graph by hooking and pointer
jumping. ``update_table`` keeps a component table from batch to batch, ``save_table`` and ``load_table``
keep it in a named folder from run to run: components that have a split keep it, a batch that would merge components of
different splits is quarantined until ``settle``, and ``fill_deficits`` gives the new ones
to the splits that lack most. ``torn`` finds the components whose records carry
more than one recorded split.

Scale. The graph is over link keys (names, sources, authors), never over rows;
a key shared by a third of all rows is one node. Each round replaces the edges
by the edges between roots and writes them to the shared folder, so the work
shrinks and no lineage grows. What reaches the driver is of fixed size: the
sizes of at most BUCKETS hash buckets and of the components larger than
1 / GIANTS of all records, of which there are at most GIANTS.

Defined results: NULL keys link nothing and belong to no component; repeated
rows count once; an empty batch leaves the table as it is; a component is named
by its least key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tacticmill.session import cut

BUCKETS, GIANTS = 1024, 1000


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is the least node."""
    both = edges.where("a is not null and b is not null").select("a", "b")
    edges = cut(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    parents = cut(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")), "cc-nodes")
    edges = edges.where("a <> b")
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        # hook every root to its least neighbour, then jump until the pointers of this round are flat
        hooks = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
        up = cut(ends.join(hooks, "node", "left").select("node", F.coalesce("up", "node").alias("up")), "cc-hook")
        while True:
            over = up.select(F.col("node").alias("up"), F.col("up").alias("next"))
            jumped = cut(up.join(over, "up").select("node", F.col("next").alias("up"), (F.col("up") != F.col("next")).alias("moved")), "cc-jump")
            up = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        a, b = up.select(F.col("node").alias("a"), F.col("up").alias("ua")), up.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        moved = edges.join(a, "a").join(b, "b").where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"))
        edges = cut(moved.distinct(), "cc-edges")
        parents = cut(parents.join(up.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "cc-nodes")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return parents.select("node", F.col("root").alias("component"))


def key_edges(links: DataFrame) -> DataFrame:
    """Edges from the least key of each record to its other keys. links: (record, keys array)."""
    keys = F.array_sort(F.array_distinct(F.filter("keys", lambda k: k.isNotNull())))
    return links.select(keys.alias("keys")).where("size(keys) > 0").distinct().select(F.col("keys")[0].alias("a"), F.explode("keys").alias("b")).distinct()


TABLE = ["node", "component", "split", "status", "conflict"]


def update_table(table: DataFrame | None, links: DataFrame) -> DataFrame:
    """The component table after a batch: (node, component, split, status, conflict).

    table: the table of earlier batches, or None. status is ``kept`` (has a split from before), ``new`` (no split
    yet) or ``quarantined``: links join components of different splits. Then conflict names the
    group of components concerned, its components keep their names and splits, nodes first
    seen in it are components of their own without a split, and all of it stays so in later batches until ``settle``.

    Only the components that the batch or a conflict it touches names enter the iteration; the
    table itself is joined twice, on node and on component.
    """
    edges = key_edges(links)
    if table is None:
        return components(edges).select("node", "component", F.lit(None).cast("string").alias("split"), F.lit("new").alias("status"), F.lit(None).cast("string").alias("conflict"))
    if "conflict" not in table.columns:
        table = table.withColumn("conflict", F.lit(None).cast("string"))
    keys = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    seen = cut(keys.join(table, "node", "left").select("node", F.coalesce("component", "node").alias("part"), "conflict", F.col("component").isNull().alias("fresh")), "cc-seen")
    a, b = (seen.select(F.col("node").alias(k), F.col("part").alias(f"part_{k}")) for k in "ab")
    between = edges.join(a, "a").join(b, "b").select(F.col("part_a").alias("a"), F.col("part_b").alias("b"))
    hit = seen.where("conflict is not null").select("conflict").distinct()
    open_conflicts = table.join(hit, "conflict", "left_semi").select(F.col("component").alias("a"), F.col("conflict").alias("b"))
    merged = components(between.union(open_conflicts)).select(F.col("node").alias("part"), F.col("component").alias("root"))
    before = table.join(merged.select(F.col("part").alias("component")), "component", "left_semi").groupBy(F.col("component").alias("part")).agg(F.max("split").alias("own"))
    known = cut(merged.join(before, "part", "left"), "cc-merged")
    roots = known.groupBy("root").agg(F.min("own").alias("least"), F.max("own").alias("most"), F.countDistinct("own").alias("splits"))
    conflict = F.col("splits") > 1
    now = known.join(roots, "root").select(
        "part",
        F.when(conflict, F.col("part")).otherwise(F.col("root")).alias("new_component"),
        F.when(conflict, F.col("own")).otherwise(F.col("least")).alias("new_split"),
        F.when(conflict, F.lit("quarantined")).when(F.col("least").isNotNull(), F.lit("kept")).otherwise(F.lit("new")).alias("new_status"),
        F.when(conflict, F.col("root")).alias("new_conflict"),
    )
    now = cut(now, "cc-now")
    touched = F.col("new_component").isNotNull()
    calm = F.when(F.col("conflict").isNotNull(), F.lit("quarantined")).when(F.col("split").isNotNull(), F.lit("kept")).otherwise(F.lit("new"))
    old = table.join(now.withColumnRenamed("part", "component"), "component", "left").select(
        "node",
        F.coalesce("new_component", "component").alias("component"),
        F.when(touched, F.col("new_split")).otherwise(F.col("split")).alias("split"),
        F.coalesce("new_status", calm).alias("status"),
        F.when(touched, F.col("new_conflict")).otherwise(F.col("conflict")).alias("conflict"),
    )
    added = seen.where("fresh").join(now, "part").select("node", F.col("new_component").alias("component"), F.col("new_split").alias("split"), F.col("new_status").alias("status"), F.col("new_conflict").alias("conflict"))
    return old.union(added)


def settle(table: DataFrame, decisions: DataFrame) -> DataFrame:
    """table after decisions (conflict, split): the components of a settled conflict become one, in the split decided."""
    chosen = decisions.where("conflict is not null and split is not null").groupBy("conflict").agg(F.min("split").alias("decided"))
    both = table.join(chosen, "conflict", "left")
    done = F.col("decided").isNotNull()
    return both.select(
        "node", F.when(done, F.col("conflict")).otherwise(F.col("component")).alias("component"), F.coalesce("decided", "split").alias("split"),
        F.when(done, F.lit("kept")).otherwise(F.col("status")).alias("status"), F.when(~done, F.col("conflict")).alias("conflict"),
    )


def _versions(spark: SparkSession, folder: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))


def load_table(spark: SparkSession, folder: str) -> DataFrame | None:
    """The last complete version of the component table in a folder, or None."""
    versions = _versions(spark, folder)
    return spark.read.parquet(f"{folder}/v{versions[-1]}").select(*TABLE) if versions else None


def save_table(table: DataFrame, folder: str) -> DataFrame:
    """Writes table as the next version in a folder; a version that was not finished does not count."""
    spark = table.sparkSession
    version = (_versions(spark, folder) or [0])[-1] + 1
    table.select(*TABLE).write.mode("overwrite").parquet(f"{folder}/v{version}")
    return load_table(spark, folder)


def fill_deficits(table: DataFrame, sizes: DataFrame, ratios: DataFrame) -> DataFrame:
    """table with a split for every new component.

    sizes: (component, records); ratios: (split, ratio). Giant components go
    first, one by one, to the split that lacks most records; the others by
    hash bucket, largest bucket first. A component is never divided.
    """
    wanted = {r["split"]: float(r["ratio"]) for r in ratios.select("split", "ratio").where("split is not null and ratio > 0").collect()}
    if not wanted:
        return table
    heads = table.groupBy("component").agg(F.max("split").alias("split"), F.min("status").alias("status"))
    sized = cut(heads.join(sizes, "component", "left").select("component", "split", "status", F.coalesce("records", F.lit(0)).alias("records")), "split-sizes")
    total = sized.agg(F.sum("records")).first()[0] or 0
    have = {r["split"]: r["n"] for r in sized.where("split is not null").groupBy("split").agg(F.sum("records").alias("n")).collect()}
    share = sum(wanted.values())
    lack = {s: total * w / share - have.get(s, 0) for s, w in wanted.items()}
    new = sized.where("split is null and status = 'new'")
    giant = F.col("records") * GIANTS > total
    bucket = F.pmod(F.xxhash64("component"), F.lit(BUCKETS)).cast("int")

    def pick(n: int) -> str:
        s = max(lack, key=lambda k: (lack[k], k))
        lack[s] -= n
        return s

    giants = new.where(giant).orderBy(F.desc("records"), "component").collect()
    by_giant = [(r["component"], pick(r["records"])) for r in giants]
    buckets = new.where(~giant).groupBy(bucket.alias("bucket")).agg(F.sum("records").alias("records")).orderBy(F.desc("records"), "bucket").collect()
    by_bucket = [(r["bucket"], pick(r["records"])) for r in buckets]
    spark = table.sparkSession
    g = spark.createDataFrame(by_giant, f"component {dict(table.dtypes)['component']}, giant_split string")
    b = spark.createDataFrame(by_bucket, "bucket int, bucket_split string")
    drawn = new.withColumn("bucket", bucket).join(F.broadcast(g), "component", "left").join(F.broadcast(b), "bucket", "left")
    drawn = drawn.select("component", F.coalesce("giant_split", "bucket_split").alias("drawn"))
    return table.join(drawn, "component", "left").select("node", "component", F.coalesce("split", "drawn").alias("split"), "status", "conflict")


def torn(table: DataFrame, recorded: DataFrame) -> DataFrame:
    """Components whose records carry more than one recorded split. recorded: (node, split)."""
    seen = recorded.where("split is not null").distinct()
    return table.join(seen.withColumnRenamed("split", "recorded"), "node").groupBy("component").agg(F.min("recorded").alias("a"), F.max("recorded").alias("b")).where("a <> b").select("component")


def theorem_key(name: Column) -> Column:
    """One spelling for a qualified name: blanks at the ends, quotation of segments, a root prefix and a
    segment written twice in a row are dropped; primes, suffixes and namespaces stay."""
    bare = F.regexp_replace(name, r"(?U)^[\s​﻿]+|[\s​﻿]+$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, "[«»]", ""), r"^(_root_\.)+", "")
    parts = F.split(bare, r"\.")
    once = F.filter(parts, lambda s, i: (i == 0) | (s != F.get(parts, i - 1)))
    joined = F.array_join(once, ".")
    return F.when(joined != "", joined)
