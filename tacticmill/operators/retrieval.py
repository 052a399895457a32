"""Symbolic and dense retrieval, fusion, negatives, and a cell index for vectors."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tacticmill.functions.text import identifiers
from tacticmill.session import cut, shared_path

QUERY_BLOCK, VECTOR_BLOCK = 8192, 8192  # rows of the two sides that one task multiplies
STRIPE = 256  # queries whose scores are in memory at once
MAX_CELLS, CELL_SAMPLE = 4096, 39  # cells of an index at most, and vectors sampled for each; both bound what reaches the driver
FLAT_BELOW = 10_000  # vectors up to which an index is searched whole
PROBE_SAMPLE, PROBE_K, PROBE_SHARE = 128, 10, 0.95  # sampled vectors, their neighbours, and the share of these that the probed cells are to hold


def inner_product(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    n = F.sqrt(inner_product(v, v))
    return F.transform(v, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def top_k(scored: DataFrame, group: str, order: list[Column | str], k: int) -> DataFrame:
    """The first k of each group with their 0-based rank; the order must be total."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).where(F.col("rank") < k)


def _overlap_topk(qid: str, name: str, k: int):
    """The k documents of a block that share most tokens with each query of a block, ties by name; documents that share none are left out."""

    def run(queries: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        docs = docs.sort_values(name, kind="stable")
        names, sizes = docs[name].to_numpy(), docs["tokens"].map(len).to_numpy(dtype=np.int64)
        where: dict[str, list[int]] = {}
        for i, tokens in enumerate(docs["tokens"]):
            for t in tokens:
                where.setdefault(t, []).append(i)
        at = {t: np.array(rows) for t, rows in where.items()}
        out: list[tuple] = []
        for q, tokens in zip(queries[qid], queries["tokens"]):
            lists = [at[t] for t in tokens if t in at]
            if not lists:
                continue
            overlap = np.bincount(np.concatenate(lists), minlength=len(names))
            # documents are in the order of their names, so a stable sort settles ties
            best = np.argsort(-overlap, kind="stable")[:k]
            out += [(q, names[i], overlap[i], len(tokens), sizes[i]) for i in best if overlap[i]]
        return pd.DataFrame(out, columns=[qid, name, "overlap", "q_size", "d_size"])

    return run


def blocks_of(queries: DataFrame, qid: str, docs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``block`` and ``chunk``: every pair of a query block and a document chunk meets once.

    Hash blocks of an expected size of QUERY_BLOCK and VECTOR_BLOCK rows.
    """
    blocks, chunks = max(1, -(-queries.count() // QUERY_BLOCK)), max(1, -(-docs.count() // VECTOR_BLOCK))
    q = queries.withColumn("block", F.pmod(F.xxhash64(qid), F.lit(blocks)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    d = docs.withColumn("chunk", F.pmod(F.xxhash64(name), F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return q, d


def symbolic_topk(queries: DataFrame, qid: str, text: str, docs: DataFrame, name: str, doc_text: str, k: int) -> DataFrame:
    """(qid, name, overlap, score, rank): by number of shared tokens, then name; the score is the Jaccard similarity.

    Blocks of queries meet blocks of documents; a task holds the inverted index of its block, counts
    overlaps along the postings and keeps k documents of each query. Pairs never become rows, so a token
    that every document holds costs time in its tasks but no shuffle. Names are keys.
    """
    kinds = dict(queries.select(qid).dtypes) | dict(docs.select(name).dtypes)
    q = queries.select(qid, identifiers(F.col(text)).alias("tokens")).where(F.size("tokens") > 0)
    d = docs.where(F.col(name).isNotNull()).select(name, identifiers(F.col(doc_text)).alias("tokens")).where(F.size("tokens") > 0)
    q, d = blocks_of(q, qid, d, name)
    hits = q.groupBy("block", "chunk").cogroup(d.groupBy("block", "chunk")).applyInPandas(_overlap_topk(qid, name, k), f"{qid} {kinds[qid]}, {name} {kinds[name]}, overlap long, q_size long, d_size long")
    scored = hits.withColumn("score", F.round(F.col("overlap") / (F.col("q_size") + F.col("d_size") - F.col("overlap")), 6))
    return top_k(scored, qid, [F.desc("overlap"), name], k).select(qid, name, "overlap", "score", "rank")


def _block_topk(qid: str, name: str, k: int):
    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        ids, names = queries[qid].to_numpy(), vectors[name].to_numpy()
        rows, found, kept = [], [], []
        if len(ids) and len(names):
            q, v = np.array(queries["v"].tolist(), dtype=np.float64), np.array(vectors["v"].tolist(), dtype=np.float64).T
            for start in range(0, len(q), STRIPE):
                for i, row in enumerate(np.round(q[start : start + STRIPE] @ v, 6), start):
                    # all names tied with the k-th stay, so the final order is exact
                    edge = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                    at = np.flatnonzero(row >= edge)
                    rows.append(np.full(len(at), i))
                    found.append(at)
                    kept.append(row[at])
        if not rows:
            return pd.DataFrame({qid: ids[:0], name: names[:0], "score": np.empty(0)})
        return pd.DataFrame({qid: ids[np.concatenate(rows)], name: names[np.concatenate(found)], "score": np.concatenate(kept)})

    return run


def dense_topk(queries: DataFrame, qid: str, vectors: DataFrame, name: str, vector: str, k: int, exclude_self: bool = False) -> DataFrame:
    """(qid, name, score, rank) by inner product, exact, ties by name.

    Queries and vectors are cut into hash blocks of a bounded expected size;
    each pair of blocks is one matrix product in one task that keeps k of each
    query, so neither side is broadcast and pairs never become rows. A vector is shuffled once for every
    QUERY_BLOCK queries; for query sets that grow with the vectors take ``search`` on an index.
    """
    kinds = dict(queries.select(qid).dtypes) | dict(vectors.select(name).dtypes)
    q, v = blocks_of(queries.select(qid, F.col(vector).alias("v")), qid, vectors.select(name, F.col(vector).alias("v")), name)
    partial = q.groupBy("block", "chunk").cogroup(v.groupBy("block", "chunk")).applyInPandas(_block_topk(qid, name, k + (1 if exclude_self else 0)), f"{qid} {kinds[qid]}, {name} {kinds[name]}, score double")
    if exclude_self:
        partial = partial.where(F.col(qid) != F.col(name))
    return top_k(partial, qid, [F.desc("score"), name], k).select(qid, name, "score", "rank")


def reciprocal_rank_fusion(lists: list[DataFrame], qid: str, name: str, k: int, constant: int = 60) -> DataFrame:
    """(qid, name, score, rank): sum of 1 / (constant + rank + 1) over the lists."""
    rows = lists[0].select(qid, name, "rank")
    for other in lists[1:]:
        rows = rows.union(other.select(qid, name, "rank"))
    fused = rows.groupBy(qid, name).agg(F.round(F.sum(1.0 / (F.col("rank") + 1 + constant)), 9).alias("score"))
    return top_k(fused, qid, [F.desc("score"), name], k).select(qid, name, "score", "rank")


def hashed_vectors(df: DataFrame, key: str, text: str, dims: int = 64) -> DataFrame:
    """(key, v): unit vectors of token counts by hash dimension, a deterministic stand-in for an encoder."""
    t = df.select(F.col(key), F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"([A-Za-z_][\p{L}\p{N}_.]*)"), 1)).alias("token"))
    counts = t.groupBy(key, (F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("long") % dims).cast("int").alias("dim")).agg(F.count("*").cast("double").alias("n"))
    maps = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("dim", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("norm"))
    return maps.select(key, dense.alias("v"))


def hard_negatives(neighbours: DataFrame, positives: DataFrame, qid: str, name: str, k: int) -> DataFrame:
    """(qid, name, score, rank): the k nearest neighbours that are no positive of the query."""
    kept = neighbours.join(positives.select(qid, name).distinct(), [qid, name], "left_anti").drop("rank")
    return top_k(kept, qid, [F.desc("score"), name], k)


# ---- vector cells


def _nearest(cells: np.ndarray, n: int):
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def cell(v: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), dtype=np.float64)
        return pd.Series(list(np.argsort(-(x @ cells.T), axis=1, kind="stable")[:, :n].astype(np.int32)))

    return cell


def fit_cells(vectors: DataFrame, vector: str, n_cells: int, rounds: int = 10, seed: int = 42) -> np.ndarray:
    """Unit centroids by spherical k-means on a hash-ordered sample of at most CELL_SAMPLE vectors, or 20,000 in all, for each cell."""
    size = max(20_000, CELL_SAMPLE * n_cells)
    rows = vectors.select(F.col(vector).alias("v")).withColumn("h", F.xxhash64(F.col("v"), F.lit(seed))).orderBy("h").limit(size).collect()
    x = np.array([r["v"] for r in rows], dtype=np.float64)
    if not len(x):
        return np.zeros((1, 1))
    centres = x[np.linspace(0, len(x) - 1, min(n_cells, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        held = np.bincount(own, minlength=len(centres)) > 0
        centres[held] = sums[held]
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def effective_cells(n: int, n_cells: int | None = None) -> int:
    """Cells for n vectors: 4 sqrt(n) unless given, with CELL_SAMPLE vectors each at least and MAX_CELLS at most."""
    return max(1, min(n_cells or int(4 * np.sqrt(n)), n // CELL_SAMPLE, MAX_CELLS))


class CellIndex(NamedTuple):
    """Centroids (at most MAX_CELLS rows) and the table (name, v, cell) of all vectors. One cell means: search everything."""

    centres: np.ndarray
    table: DataFrame
    name: str
    probe: int  # cells that hold the wanted share of the neighbours of sampled vectors


def build_index(vectors: DataFrame, name: str, vector: str, folder: str, n_cells: int | None = None, flat_below: int = FLAT_BELOW) -> CellIndex:
    """Indexes every vector and writes the index to a folder: ``centres`` and ``vectors``, sorted by cell.

    Up to ``flat_below`` vectors there is one cell, so the search is exact. Beyond, the neighbours of
    PROBE_SAMPLE vectors are searched exactly in one pass to learn how many cells a search has to probe.
    """
    spark = vectors.sparkSession
    n = vectors.count()
    centres = np.zeros((1, 1)) if n <= flat_below else fit_cells(vectors, vector, effective_cells(n, n_cells))
    cell = F.lit(0) if len(centres) == 1 else _nearest(centres, 1)(F.col(vector))[0]
    placed = vectors.select(F.col(name), F.col(vector).alias("v"), cell.cast("int").alias("cell"))
    placed.repartitionByRange("cell", F.xxhash64(name)).sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{folder}/vectors")
    probe = 1 if len(centres) == 1 else _probe(centres, spark.read.parquet(f"{folder}/vectors"), name)
    rows = [(i, [float(x) for x in c], probe) for i, c in enumerate(centres)]
    spark.createDataFrame(rows, "cell int, centre array<double>, probe int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centres")
    return read_index(spark, folder, name)


def read_index(spark: SparkSession, folder: str, name: str) -> CellIndex:
    rows = spark.read.parquet(f"{folder}/centres").orderBy("cell").collect()
    return CellIndex(np.array([r["centre"] for r in rows]), spark.read.parquet(f"{folder}/vectors"), name, rows[0]["probe"])


def _probe(centres: np.ndarray, table: DataFrame, name: str) -> int:
    """How many cells, nearest first, hold PROBE_SHARE of the neighbours of sampled vectors."""
    picked = table.orderBy(F.xxhash64(name), name).limit(PROBE_SAMPLE).select(F.col(name).alias("_q"), "v")
    picked = cut(picked, "probe-sample")
    near = dense_topk(picked, "_q", table, name, "v", PROBE_K, exclude_self=False).join(table.select(name, "cell"), name)
    # at most PROBE_SAMPLE vectors, and PROBE_K neighbours of each
    own = {r["_q"]: np.argsort(-(centres @ np.array(r["v"], dtype=np.float64)), kind="stable") for r in picked.collect()}
    ranks = sorted(int(np.flatnonzero(own[r["_q"]] == r["cell"])[0]) for r in near.select("_q", "cell").collect())
    return ranks[min(len(ranks) - 1, int(PROBE_SHARE * len(ranks)))] + 1 if ranks else 1


def build_cell_index(vectors: DataFrame, name: str, vector: str, n_cells: int | None = None) -> tuple[np.ndarray, DataFrame]:
    """(centroids, table (name, v, cell)) of an index in cells, written to a fresh shared folder."""
    index = build_index(vectors, name, vector, shared_path(vectors.sparkSession, "cells"), n_cells, flat_below=0)
    return index.centres, index.table


def search(queries: DataFrame, qid: str, vector: str, index: CellIndex, k: int, probe: int | None = None) -> DataFrame:
    """(qid, name, score, rank) by an index."""
    return cell_search(queries, qid, vector, index.centres, index.table, index.name, k, probe or index.probe)


def cell_search(queries: DataFrame, qid: str, vector: str, centres: np.ndarray, index: DataFrame, name: str, k: int, probe: int | None = None) -> DataFrame:
    """(qid, name, score, rank): exact scores inside the probed cells, 16 of them or an eighth.

    A cell is cut into hash chunks of a bounded expected size; a query goes to the chunks of its
    cells, and each pair of blocks is one matrix product that keeps k of each query. A vector is
    shuffled once for every QUERY_BLOCK queries that probe its cell.
    """
    kinds = dict(queries.select(qid).dtypes) | dict(index.select(name).dtypes)
    probe = probe or max(16, len(centres) // 8)
    probed = F.array(F.lit(0)) if len(centres) == 1 else _nearest(centres, min(probe, len(centres)))(F.col(vector))
    q = queries.select(F.col(qid), F.col(vector).alias("v"), F.explode(probed).alias("cell"))
    # one row for each cell
    sizes = index.groupBy("cell").agg(F.ceil(F.count("*") / VECTOR_BLOCK).cast("int").alias("chunks")).join(q.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks")), "cell")
    sizes = F.broadcast(cut(sizes, "cell-sizes"))
    q = q.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64(qid), F.col("blocks")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    v = index.join(sizes, "cell").withColumn("chunk", F.pmod(F.xxhash64(name), F.col("chunks")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    by = ["cell", "block", "chunk"]
    partial = q.select(*by, qid, "v").groupBy(*by).cogroup(v.select(*by, name, "v").groupBy(*by)).applyInPandas(_block_topk(qid, name, k), f"{qid} {kinds[qid]}, {name} {kinds[name]}, score double")
    return top_k(partial, qid, [F.desc("score"), name], k).select(qid, name, "score", "rank")


def recall(found: DataFrame, truth: DataFrame, qid: str, name: str) -> DataFrame:
    """One row: share of the true neighbours that were found."""
    hit = truth.select(qid, name).join(found.select(qid, name).withColumn("hit", F.lit(1)), [qid, name], "left")
    return hit.agg(F.count("*").alias("wanted"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))
