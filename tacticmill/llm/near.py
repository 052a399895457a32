"""Near-duplicate records with small edits.

``near_pairs`` lists the pairs of records whose sets of word runs have a
Jaccard similarity of at least a threshold; ``near_groups`` gives one row for
each record: its group, the class of exact copies it belongs to, and its
number of links.

Method. Each record's set of hashed word runs is sketched by MinHash. Bands of
the signature give candidates. Candidates are pruned by Bayesian inference on
the signature (its low bits): values are compared a few at a time and a pair
is dropped as soon as the posterior probability that its similarity reaches
the threshold, given the agreements so far and a uniform prior, is below a
tolerance. What is left is verified exactly on the texts.

Scale. Records with equal sets form one class, and only classes are compared,
so a text repeated by a third of all rows costs one class. Nothing is compared
outside a shared band; bands that hold many classes are found on a hashed
share of the classes and salted into block pairs, so no task gets a whole hot
band; the joins are plain equi-joins that adaptive execution may split. No
bucket, partner or candidate is capped.

Recall of the bands is 1 - (1 - s^r)^b: with the defaults 0.9963 at s = 0.5 and
0.9998 at s = 0.6. The tolerance of the pruning is 1e-4.

Defined results: a row without an id is no record; NULL counts as empty text; records of fewer than
``min_words`` words take no part; repeated rows of an id count once; ties and
equal texts are pairs of similarity 1; an empty table gives no pair; columns
other than those named are ignored; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tacticmill.llm.hashing import WordHasher, band_keys, low_bits, minhash, seeds, segment_keys, set_digest, shingles
from tacticmill.session import cut

CODE = 64  # signature values kept for pruning, 8 bits each
STEPS = (16, 32, 48, 64)
SHARE = 64  # hot bands are looked for among one in SHARE classes
BLOCK = 1024  # classes in one salted block
MEMBERS = 4096  # members of a class in one block of pairs
FINGERPRINT = "id long, cls long, side string, keys array<long>, code binary, bits long"


def lower_words(text: str) -> list[str]:
    return text.lower().split()


def fingerprints(width: int, bands: int, rows: int, min_words: int, words_of: Callable[[str], list[str]] = lower_words, code_size: int = CODE, segments: bool = False):
    """A mapInPandas function: (id, side, parts) to FINGERPRINT.

    The digest of the set names the record's class. Keys and codes are given
    with the first record of a class and side in its partition only. The keys are those of
    bands of whole signature values or, with ``segments``, the segments of the code themselves.
    """
    perms = seeds(max(bands * rows, code_size), width)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, seen = WordHasher(), set()
        for batch in batches:
            ids, sides, sets, classes, fresh = [], [], [], [], []
            for rid, side, parts in zip(batch["id"], batch["side"], batch["parts"]):
                words = words_of(" ".join(p if p is not None else "" for p in parts))
                if len(words) < max(min_words, width):
                    continue
                s = shingles(hasher(words), width)
                c = set_digest(s)
                ids.append(rid)
                sides.append(side)
                classes.append(c)
                if len(seen) > 1_000_000:
                    seen.clear()
                if (c, side) in seen:
                    fresh.append(False)
                else:
                    seen.add((c, side))
                    fresh.append(True)
                    sets.append(s)
            if not ids:
                continue
            keys: list = [None] * len(ids)
            codes: list = [None] * len(ids)
            bits: list = [None] * len(ids)
            at = [i for i, f in enumerate(fresh) if f]
            for start in range(0, len(sets), 256):
                part = at[start : start + 256]
                sig = minhash(sets[start : start + 256], perms)
                code = low_bits(sig[:, :code_size])
                packed = np.packbits(code[:, :64] & 1, axis=1).view(np.int64).reshape(-1)
                found = segment_keys(code[:, : bands * rows], rows) if segments else band_keys(sig[:, : bands * rows], rows)
                for i, k, c, b in zip(part, found, code, packed):
                    keys[i], codes[i], bits[i] = k, c.tobytes(), int(b)
            yield pd.DataFrame({"id": pd.array(ids, dtype="int64"), "cls": pd.array(classes, dtype="int64"), "side": sides, "keys": keys, "code": codes, "bits": pd.array(bits, dtype="Int64")})

    return run


def hot_bands(rows: DataFrame, classes: int) -> DataFrame:
    """(key, blocks) of the bands that hold many classes.

    Estimated on the classes whose digest falls in one of SHARE residues; it
    only decides how the work is cut up. A hot band holds at least 1/500 of
    the looked-at classes, so there are at most 500 times the number of bands.
    """
    least = max(16, classes // SHARE // 500)
    return (
        rows.where(F.pmod(F.xxhash64("cls"), F.lit(SHARE)) == 0)
        .groupBy("key")
        .count()
        .where(F.col("count") >= least)
        .select("key", F.greatest(F.lit(2), (F.col("count") * SHARE / BLOCK).cast("int")).alias("blocks"))
    )


def _blocked(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Adds the block of the row and the number of blocks of its band."""
    joined = rows.join(F.broadcast(hot), "key", "left")
    blocks = F.coalesce("blocks", F.lit(1))
    return joined.withColumn("blocks", blocks).withColumn("i", F.pmod(F.xxhash64("cls", F.lit(1)), blocks).cast("int"))


def self_join(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Distinct class pairs (ca < cb) that share a band. Row of block i goes to the cells {i, j} of all j."""
    cells = _blocked(rows, hot).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("key", "cls", "i", (F.least("i", "j") * F.col("blocks") + F.greatest("i", "j")).alias("cell"), (F.col("i") == F.col("j")).alias("own"))
    a, b = cells.alias("a"), cells.alias("b")
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.cls") < F.col("b.cls")) & (F.col("a.own") | (F.col("a.i") != F.col("b.i")))
    return a.join(b, on).select(F.col("a.cls").alias("ca"), F.col("b.cls").alias("cb")).distinct()


@lru_cache(maxsize=None)
def least_matches(threshold: float, tolerance: float, bits: int = 8) -> tuple[int, ...]:
    """For each of STEPS, the fewest agreements at which P(similarity >= threshold) reaches the tolerance."""
    x = np.linspace(0.0, 1.0, 20001)[1:-1]
    agree = x + (1 - x) / (1 << bits)
    out = []
    for n in STEPS:
        m = np.arange(n + 1)[:, None]
        log = m * np.log(agree)[None, :] + (n - m) * np.log1p(-agree)[None, :]
        weight = np.exp(log - log.max(axis=1, keepdims=True))
        posterior = weight[:, x >= threshold].sum(axis=1) / weight.sum(axis=1)
        out.append(int(np.argmax(posterior >= tolerance)))
    return tuple(out)


def survives(threshold: float, tolerance: float) -> Callable[[Column, Column], Column]:
    least = least_matches(threshold, tolerance)

    @F.pandas_udf(T.BooleanType())
    def check(left: pd.Series, right: pd.Series) -> pd.Series:
        a = np.frombuffer(b"".join(left), dtype=np.uint8).reshape(-1, CODE)
        b = np.frombuffer(b"".join(right), dtype=np.uint8).reshape(-1, CODE)
        alive = np.arange(len(a))
        matches = np.zeros(len(a), dtype=np.int64)
        start = 0
        for stop, need in zip(STEPS, least):
            matches[alive] += (a[alive, start:stop] == b[alive, start:stop]).sum(axis=1)
            alive = alive[matches[alive] >= need]
            start = stop
        keep = np.zeros(len(a), dtype=bool)
        keep[alive] = True
        return pd.Series(keep)

    return check


def with_codes(pairs: DataFrame, fp: DataFrame, left: str = "ca", right: str = "cb") -> DataFrame:
    codes = fp.where("code is not null").select("cls", "code").dropDuplicates(["cls"])
    out = pairs.join(codes.select(F.col("cls").alias(left), F.col("code").alias("code_a")), left)
    return out.join(codes.select(F.col("cls").alias(right), F.col("code").alias("code_b")), right)


def exact_jaccard(width: int, words_of: Callable[[str], list[str]] = lower_words) -> Callable[[Column, Column], Column]:
    """Jaccard similarity of the sets of word runs themselves, not of their hashes."""

    @F.pandas_udf(T.DoubleType())
    def jaccard(left: pd.Series, right: pd.Series) -> pd.Series:
        known: dict[str, frozenset] = {}

        def runs(text: str) -> frozenset:
            got = known.get(text)
            if got is None:
                w = words_of(text)
                got = known[text] = frozenset(zip(*(w[i:] for i in range(width))))
            return got

        out = []
        for a, b in zip(left, right):
            x, y = runs(a), runs(b)
            inter = len(x & y)
            union = len(x) + len(y) - inter
            out.append(inter / union if union else 0.0)
        return pd.Series(out, dtype="float64")

    return jaccard


def joined_text(parts: list[str]) -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col(p), F.lit("")) for p in parts])


def verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame, similarity: Callable, threshold: float, left: str = "ca", right: str = "cb") -> DataFrame:
    """Class pairs whose representatives' texts reach the threshold, with the similarity.

    reps: (cls, rep); texts: (id, text), perhaps with repeated rows.
    """
    named = pairs.join(reps.select(F.col("cls").alias(left), F.col("rep").alias("ra")), left).join(reps.select(F.col("cls").alias(right), F.col("rep").alias("rb")), right)
    needed = named.select(F.col("ra").alias("id")).union(named.select(F.col("rb").alias("id"))).distinct()
    own = texts.join(needed, "id", "left_semi").dropDuplicates(["id"])
    full = named.join(own.select(F.col("id").alias("ra"), F.col("text").alias("ta")), "ra").join(own.select(F.col("id").alias("rb"), F.col("text").alias("tb")), "rb")
    return full.withColumn("similarity", similarity(F.col("ta"), F.col("tb"))).where(F.col("similarity") >= threshold).select(left, right, "similarity")


def near_classes(
    df: DataFrame,
    key: str,
    parts: list[str],
    width: int = 3,
    threshold: float = 0.5,
    min_words: int = 20,
    bands: int = 42,
    rows: int = 3,
    tolerance: float = 1e-4,
) -> tuple[DataFrame, DataFrame]:
    """(links, members): links (ca, cb, similarity) between classes, members (cls, id)."""
    df = df.where(F.col(key).isNotNull())
    source = df.select(F.col(key).cast("long").alias("id"), F.lit(None).cast("string").alias("side"), F.array(*parts).alias("parts"))
    fp = cut(source.mapInPandas(fingerprints(width, bands, rows, min_words), FINGERPRINT), "near-fp")
    members = fp.select("cls", "id").distinct()
    reps = members.groupBy("cls").agg(F.min("id").alias("rep"))
    band_rows = fp.where("keys is not null").select("cls", F.explode("keys").alias("key"))
    hot = cut(hot_bands(band_rows, fp.where("keys is not null").count()), "near-hot")
    candidates = self_join(band_rows, hot)
    kept = with_codes(candidates, fp).where(survives(threshold, tolerance)(F.col("code_a"), F.col("code_b"))).select("ca", "cb")
    texts = df.select(F.col(key).cast("long").alias("id"), joined_text(parts).alias("text"))
    links = verified(cut(kept, "near-kept"), reps, texts, exact_jaccard(width), threshold)
    return links, members


def _in_blocks(members: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(members with their block, (cls, blocks) of the classes of more than MEMBERS members)."""
    large = members.groupBy("cls").count().where(F.col("count") > MEMBERS).select("cls", F.ceil(F.col("count") / MEMBERS).cast("int").alias(f"blocks_{name}"))
    block = F.when(F.col(f"blocks_{name}").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col(f"blocks_{name}")).cast("int"))
    return members.join(large, "cls", "left").select(F.col("cls").alias(f"c{name}"), block.alias(f"block_{name}"), F.col("id").alias(f"id_{name}")), large


def spread(links: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(ca, cb, id_a, id_b) of all members of linked classes. links: (ca, cb); left, right: (cls, id).

    A large class is cut into blocks and its links go to the pairs of blocks, so that no task
    gets all pairs of one class.
    """
    a, large_a = _in_blocks(left, "a")
    b, large_b = _in_blocks(right, "b")
    cells = links.join(large_a.withColumnRenamed("cls", "ca"), "ca", "left").join(large_b.withColumnRenamed("cls", "cb"), "cb", "left")
    for name in "ab":
        cells = cells.withColumn(f"block_{name}", F.explode(F.sequence(F.lit(0), F.coalesce(f"blocks_{name}", F.lit(1)) - 1)))
    return cells.select("ca", "cb", "block_a", "block_b").join(a, ["ca", "block_a"]).join(b, ["cb", "block_b"]).select("ca", "cb", "id_a", "id_b")


def expand(links: DataFrame, members: DataFrame) -> DataFrame:
    """Record pairs (a < b): members of linked classes, and of one class."""
    shared = members.groupBy("cls").count().where("count > 1").select(F.col("cls").alias("ca"), F.col("cls").alias("cb"))
    both = spread(links.select("ca", "cb").union(shared), members, members).where("ca <> cb or id_a < id_b")
    return both.select(F.least("id_a", "id_b").alias("record_id_a"), F.greatest("id_a", "id_b").alias("record_id_b"))


def near_pairs(df: DataFrame, key: str, parts: list[str], **options) -> DataFrame:
    """(record_id_a, record_id_b), a < b, of all pairs that reach the threshold."""
    links, members = near_classes(df, key, parts, **options)
    return expand(links, cut(members, "near-members"))


def near_groups(df: DataFrame, key: str, parts: list[str], **options) -> DataFrame:
    """(key, group_id, class_id, n_links) of each record that has a near-duplicate.

    group_id is the least id of the connected group, class_id the least id
    with the same set of word runs; links are to records, copies included.
    """
    from tacticmill.llm.components import components

    links, members = near_classes(df, key, parts, **options)
    links, members = cut(links, "near-links"), cut(members, "near-members")
    sizes = members.groupBy("cls").agg(F.count("*").alias("size"), F.min("id").alias("class_id"))
    both = links.select("ca", "cb").union(links.select(F.col("cb").alias("ca"), F.col("ca").alias("cb")))
    degree = both.join(sizes.select(F.col("cls").alias("cb"), "size"), "cb").groupBy("ca").agg(F.sum("size").alias("others"))
    labels = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    info = (
        sizes.join(degree.withColumnRenamed("ca", "cls"), "cls", "left")
        .join(labels.select(F.col("node").alias("cls"), "component"), "cls", "left")
        .withColumn("n_links", F.coalesce("others", F.lit(0)) + F.col("size") - 1)
        .where("n_links > 0")
        .withColumn("component", F.coalesce("component", "cls"))
    )
    heads = info.groupBy("component").agg(F.min("class_id").alias("group_id"))
    return members.join(info, "cls").join(heads, "component").select(F.col("id").alias(key), "group_id", "class_id", "n_links")
