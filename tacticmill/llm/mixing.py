"""Mixing of sources to target weights.

``mix`` says how often each text is used so that every source holds its
target share of all tokens and no text is used more than its source's
``max_repeats`` times; ``shares`` reports what was reached.

Method. Tokens are summed by source. With p the target shares, normalised over
the sources that have tokens, N the tokens and c the caps, the largest mix
that holds the shares has T = min(c N / p) tokens; the rate of a source is
p T / N. A text is used floor(rate) times, and once more with probability equal to
the fraction, drawn by a seeded hash of its id, so a rerun or a lost executor gives
the same mix.

Scale. One pass counts tokens; equal texts are collapsed by digest in a
partial aggregate, whichever share of all rows they are; the sums by source have
one row for each source of the target table.

Defined results: texts of no tokens (NULL, empty) are not used; a text posted
under several ids counts as one text, of its least id among the rows of listed
sources; sources without a target, or NULL, get none; a listed source without texts has rate NULL and its share
goes to the others in proportion; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tacticmill.llm.encoding import count_tokens
from tacticmill.session import cut


def wanted_sources(targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats) of each source that is to get a share."""
    return targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def sized_texts(df: DataFrame, targets: DataFrame, key: str, text: str, source: str, path: str) -> DataFrame:
    """(key, source, n_tokens) of each distinct text that a source with a target holds."""
    listed = F.broadcast(wanted_sources(targets).select(F.col("source").alias(source)))
    df = df.select(key, text, source).join(listed, source, "left_semi")
    rows = df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.md5(F.col(text)).alias("digest"), count_tokens(F.col(text), path).alias("n_tokens"))
    first = rows.where("n_tokens > 0").groupBy("digest").agg(F.min(F.struct("key", "source", "n_tokens")).alias("t"))
    return first.select(F.col("t.key").alias(key), F.col("t.source").alias("source"), F.col("t.n_tokens").alias("n_tokens"))


def rates(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, available, rate) of each source of the target table."""
    wanted = wanted_sources(targets)
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    both = wanted.join(have, "source", "left")
    # one number; normalising the shares would cancel in p T / N
    room = both.agg(F.min(F.col("max_repeats") * F.col("available") / F.col("target_share"))).first()[0]
    rate = F.when(F.col("available").isNotNull(), F.least(F.col("max_repeats").cast("double"), F.col("target_share") * F.lit(room) / F.col("available")))
    return both.select("source", "target_share", "max_repeats", "available", rate.alias("rate"))


def mix(sized: DataFrame, rate: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """(key, source, n_tokens, copies) of the texts used at least once."""
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    used = sized.join(rate.where("rate is not null").select("source", "rate"), "source")
    copies = (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return used.select(key, "source", "n_tokens", copies.alias("copies")).where("copies > 0")


def shares(mixed: DataFrame, rate: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, available, rate, texts, tokens, share) by source."""
    got = mixed.groupBy("source").agg(F.count("*").alias("texts"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"))
    # a window over one row for each listed source
    both = rate.join(got, "source", "left").withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy(F.lit(0))))
    return both.select(
        "source", "target_share", "max_repeats", F.coalesce("available", F.lit(0)).alias("available"), F.round("rate", 6).alias("rate"),
        F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.round(F.coalesce("tokens", F.lit(0)) / F.col("all_tokens"), 6).alias("share"),
    )


def mixture(df: DataFrame, targets: DataFrame, key: str, text: str, source: str, path: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(mix, shares) of a table of texts."""
    sized = cut(sized_texts(df, targets, key, text, source, path), "mix-sizes")
    rate = cut(rates(sized, targets), "mix-rates")
    mixed = mix(sized, rate, key, seed)
    return mixed, shares(mixed, rate)
