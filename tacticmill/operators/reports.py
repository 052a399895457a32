"""Aggregates behind the audit reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_counts(df: DataFrame, key: Column, n: int) -> DataFrame:
    """(key, n) of the n most frequent keys; ties by key. The counts are partial aggregates, the order a top-k."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("key")).limit(n)


def length_stats(df: DataFrame, x: Column) -> DataFrame:
    n = F.length(x)
    return df.agg(F.count(n).alias("n"), F.round(F.avg(n), 6).alias("mean"), F.max(n).alias("longest"), F.min(n).alias("shortest"), F.round(F.stddev_samp(n), 6).alias("deviation"), F.median(n).alias("median"))


def rates(df: DataFrame, conditions: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Share of rows for which each condition holds, over all rows or by group; an unknown condition does not hold."""
    aggs = [F.count("*").alias("n"), *[F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 6).alias(name) for name, c in conditions.items()]]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def cross_tab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts by row and column value with row totals; values are given, so no job looks for them."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values], F.count("*").alias("total"))


def histogram(df: DataFrame, x: Column, edges: list[int]) -> DataFrame:
    """(bin, n) over [edge, next edge); beyond the last edge is one open bin."""
    b = F.when(x < edges[0], f"<{edges[0]}")
    for lo, hi in zip(edges, edges[1:]):
        b = b.when((x >= lo) & (x < hi), f"{lo}-{hi}")
    return df.where(x.isNotNull()).groupBy(b.otherwise(f">={edges[-1]}").alias("bin")).agg(F.count("*").alias("n"))


def duplicates(df: DataFrame, x: str, prefix: int = 200) -> DataFrame:
    """Surplus rows by whole text and by prefix."""
    return df.where(F.col(x).isNotNull()).agg(
        F.count("*").alias("n"), (F.count("*") - F.countDistinct(F.md5(x))).alias("same_text"), (F.count("*") - F.countDistinct(F.substring(x, 1, prefix))).alias("same_prefix")
    )


def top_by_group(df: DataFrame, group: str, value: Column, n: int) -> DataFrame:
    """The n most frequent values of each group with their share in it; ties by value."""
    counts = df.groupBy(group, value.alias("value")).agg(F.count("*").alias("n"))
    total = Window.partitionBy(group)
    ranked = counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(total), 6)).withColumn("rank", F.row_number().over(total.orderBy(F.desc("n"), "value")))
    return ranked.where(F.col("rank") <= n)


def weighted_stats(counts: DataFrame, value: str, weight: str) -> DataFrame:
    """Statistics of a histogram without expanding it."""
    v, w = F.col(value), F.col(weight)
    return counts.agg(F.sum(w).alias("n"), F.round(F.sum(v * w) / F.sum(w), 6).alias("mean"), F.min(v).alias("lowest"), F.max(v).alias("highest"), F.expr(f"percentile({value}, 0.5, {weight})").alias("median"))


def constancy(df: DataFrame, group: str, value: str) -> DataFrame:
    """How many groups of more than one row have one value, and how many have several."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.countDistinct(value).alias("d")).where("n > 1")
    return g.agg(F.count("*").alias("groups"), F.count_if(F.col("d") <= 1).alias("constant"), F.count_if(F.col("d") > 1).alias("varying"))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")
