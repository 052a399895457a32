"""Seeded order, samples, mixes and shares; the same in every engine and on every rerun."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seeded(key: Column, seed: int) -> Column:
    """Sort key of a seeded shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement; planned as a top-k, not a full sort."""
    return df.orderBy(seeded(F.col(key), seed), key).limit(n)


def mix(new: DataFrame, base: DataFrame, key: str, base_share: float, seed: int = 42) -> DataFrame:
    """All of new, and as many of base as give it its share: min(int(n r / (1 - r)), all)."""
    n = new.count()
    wanted = int(n * base_share / (1 - base_share)) if base_share < 1 else base.count()
    return new.withColumn("origin", F.lit("new")).unionByName(sample(base, key, wanted, seed).withColumn("origin", F.lit("base")))


def best(df: DataFrame, group: str, score: Column, value: str) -> DataFrame:
    """(group, value) with the greatest score; ties by the least value."""
    return df.groupBy(group).agg(F.min_by(value, F.struct(-score, F.col(value))).alias(value))


def evicted(df: DataFrame, solved: str, visits: str, key: str, cap: int) -> DataFrame:
    """Rows to drop when more than cap are kept: unsolved and least visited first."""
    surplus = max(0, df.count() - cap)
    return df.orderBy(F.col(solved).asc(), F.col(visits).asc(), F.col(key).asc()).limit(surplus)
