"""Order-dependent operators: keep-first, gaps, caps, slices, ratio splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tacticmill.functions.text import hash_number
from tacticmill.session import cut


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column], k: int = 1) -> DataFrame:
    """The first k rows of each key. Planned as a partial and a final group limit, so a hot key ships k rows a task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def contiguity(df: DataFrame, key: str, step: str, base: int = 0) -> DataFrame:
    """(key, n, status): incomplete if steps do not start at base, gap if one is missing, else ok. Repeated steps count once."""
    agg = df.groupBy(key).agg(F.min(step).alias("lo"), F.max(step).alias("hi"), F.countDistinct(step).alias("n"))
    status = F.when(F.col("lo").isNull() | (F.col("lo") != base), "incomplete").when(F.col("hi") - F.col("lo") + 1 != F.col("n"), "gap").otherwise("ok")
    return agg.select(key, "n", status.alias("status"))


def position_class(step: Column, total: Column) -> Column:
    return F.when(step.isNull() | (step < 0), "unknown").when(step == 0, "first").when(step == total - 1, "last").otherwise("middle")


def slices(df: DataFrame, order: list[str | Column], batches: int) -> DataFrame:
    """Contiguous slices whose sizes differ by at most one, the larger first.

    Rows are range-partitioned and sorted; the offset of each partition comes
    from the partition sizes (one row for each partition), so no window runs
    over all rows in one task.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = cut(ranged, "slices")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy()).alias("total"))
    position = F.col("offset") + F.col("_in")
    small, large = F.floor(F.col("total") / batches), F.col("total") % batches
    edge = large * (small + 1)
    batch = F.when(position < edge, F.floor(position / (small + 1))).otherwise(large + F.floor((position - edge) / F.greatest(small, F.lit(1))))
    return placed.join(offsets, "_part").withColumn("batch", batch.cast("int")).drop("_part", "_in", "offset", "total")


def round_robin(df: DataFrame, key: str, workers: int) -> DataFrame:
    """Worker of each group; groups of one key stay together."""
    return df.withColumn("worker", (hash_number(F.col(key)) % workers).cast("int"))


def ratio_split(keys: DataFrame, key: str, ratios: dict[str, float], seed: int = 42) -> DataFrame:
    """(key, split): distinct keys in seeded hash order, cut at floor(n * cumulative ratio).

    The rank of a key is taken within 4096 hash ranges plus the size of the
    ranges before it, so it is exact without one task holding all keys.
    """
    distinct = keys.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))))
    distinct = distinct.withColumn("_range", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    sizes = distinct.groupBy("_range").count()
    w = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("_before"), F.sum("count").over(Window.partitionBy()).alias("_n"))
    ranked = distinct.join(F.broadcast(offsets), "_range").withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy("_h", key)) - 1)
    names, bound, split = list(ratios), 0.0, None
    for name in names[:-1]:
        bound += ratios[name]
        edge = F.floor(F.col("_n") * F.lit(round(bound, 12)))
        split = F.when(F.col("_rank") < edge, name) if split is None else split.when(F.col("_rank") < edge, name)
    return ranked.select(key, (split.otherwise(names[-1]) if split is not None else F.lit(names[-1])).alias("split"))


def nearest_rank(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row of quantiles by index: the value at position floor(n * p) of the sorted values, exact.

    Equal values are counted first. The running count is taken within value
    ranges and shifted by the sizes of the ranges before, so no task sorts all values.
    """
    spark = df.sparkSession
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    ranged = cut(counts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "v").withColumn("_part", F.spark_partition_id()), "ranks")
    sizes = ranged.groupBy("_part").agg(F.sum("c").alias("s"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition
    offsets = sizes.select("_part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"), F.sum("s").over(Window.partitionBy()).alias("n"))
    upto = F.col("offset") + F.sum("c").over(Window.partitionBy("_part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    cum = ranged.join(F.broadcast(offsets), "_part").select("v", "n", upto.alias("upto"))
    return cum.agg(*[F.min(F.when(F.col("upto") > F.floor(F.col("n") * F.lit(p)), F.col("v"))).alias(name) for name, p in shares.items()])
