"""Retrieval over the premise corpus and the vectors. Queries are the rows whose id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import functions as F

from tacticmill.functions import text as X
from tacticmill.operators import retrieval as V
from tacticmill.plans.base import ERR, query, records, table
from tacticmill.session import cut, shared_path

_TOKEN = r"[A-Za-z_][\pL\pN_.]*"
_Q = f"{ERR}, q AS (SELECT error_id AS qid, state_before AS text FROM err WHERE error_id % 100 = 0)"
_SYM = f"""{_Q}, qt AS (SELECT qid, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '{_TOKEN}'))) AS token FROM q), dt AS (SELECT name, unnest(list_distinct(regexp_extract_all(type_expr, '{_TOKEN}'))) AS token FROM corpus),
qn AS (SELECT qid, count(*) AS n FROM qt GROUP BY 1), dn AS (SELECT name, count(*) AS n FROM dt GROUP BY 1), h AS (SELECT qid, name, count(*) AS overlap FROM qt JOIN dt USING (token) GROUP BY 1, 2),
sym AS (SELECT qid, name, overlap, round(overlap / (qn.n + dn.n - overlap), 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, name) - 1 AS rank FROM h JOIN qn USING (qid) JOIN dn USING (name))"""
_DENSE = f"""qh AS (SELECT qid, CAST(('0x' || substr(md5(token), 1, 8)) AS UBIGINT) % 64 AS dim, CAST(count(*) AS DOUBLE) AS n FROM (SELECT qid, unnest(regexp_extract_all(coalesce(text, ''), '{_TOKEN}')) AS token FROM q) GROUP BY 1, 2),
dh AS (SELECT name, CAST(('0x' || substr(md5(token), 1, 8)) AS UBIGINT) % 64 AS dim, CAST(count(*) AS DOUBLE) AS n FROM (SELECT name, unnest(regexp_extract_all(type_expr, '{_TOKEN}')) AS token FROM corpus) GROUP BY 1, 2),
qv AS (SELECT qid, dim, n / sqrt(sum(n * n) OVER (PARTITION BY qid)) AS w FROM qh), dv AS (SELECT name, dim, n / sqrt(sum(n * n) OVER (PARTITION BY name)) AS w FROM dh),
ds AS (SELECT a.qid, b.name, round(coalesce(sum(qv.w * dv.w), 0), 6) + 0.0 AS score FROM (SELECT DISTINCT qid FROM qh) a CROSS JOIN (SELECT DISTINCT name FROM dh) b LEFT JOIN qv ON qv.qid = a.qid LEFT JOIN dv ON dv.name = b.name AND dv.dim = qv.dim GROUP BY 1, 2),
den AS (SELECT qid, name, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, name) - 1 AS rank FROM ds)"""
_FUSED = "fu AS (SELECT qid, name, round(sum(1.0 / (rank + 61)), 9) AS score FROM (SELECT qid, name, rank FROM sym WHERE rank < 20 UNION ALL SELECT qid, name, rank FROM den WHERE rank < 20) GROUP BY 1, 2), fused AS (SELECT qid, name, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, name) - 1 AS rank FROM fu)"


def _queries(spark, d):
    return records(spark, d, "error_records", "state_before").where("error_id % 100 = 0").select(F.col("error_id").alias("qid"), F.col("state_before").alias("text"))


def _symbolic(spark, d, k):
    return V.symbolic_topk(_queries(spark, d), "qid", "text", table(spark, d, "corpus").select("name", "type_expr"), "name", "type_expr", k)


def _dense(spark, d, k):
    q = cut(V.hashed_vectors(_queries(spark, d), "qid", "text"), "query-vectors")
    v = cut(V.hashed_vectors(table(spark, d, "corpus").select("name", "type_expr"), "name", "type_expr"), "corpus-vectors")
    return V.dense_topk(q, "qid", v, "name", "v", k)


@query(f"WITH {_SYM} SELECT qid, name, overlap, score, rank FROM sym WHERE rank < 10")
def symbolic_topk(spark, d):
    return _symbolic(spark, d, 10)


@query(f"WITH {_Q}, {_DENSE} SELECT qid, name, score, rank FROM den WHERE rank < 10")
def dense_corpus_topk(spark, d):
    return _dense(spark, d, 10)


@query("WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS qid, d.vec_id AS name, round(list_inner_product(q.e, d.e), 6) AS score FROM v q JOIN v d ON q.vec_id % 100 = 0) SELECT qid, name, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, name) - 1 AS rank FROM s QUALIFY rank < 10")
def dense_topk(spark, d):
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding"))
    return V.dense_topk(q, "qid", v.select(F.col("vec_id").alias("name"), "embedding"), "name", "embedding", 10)


@query(f"WITH {_SYM}, {_DENSE}, {_FUSED} SELECT qid, name, score, rank FROM fused WHERE rank < 10")
def rrf_fused(spark, d):
    """Hybrid retrieval: twice the depth from both lists, fused by reciprocal rank."""
    return V.reciprocal_rank_fusion([_symbolic(spark, d, 20), _dense(spark, d, 20)], "qid", "name", 10)


@query(f"WITH {_SYM}, {_DENSE}, {_FUSED} SELECT qid, string_agg((rank + 1) || '. ' || name || ' : ' || type_expr, chr(10) ORDER BY rank) AS context FROM fused JOIN corpus USING (name) WHERE rank < 5 GROUP BY qid")
def retrieval_context(spark, d):
    """Numbered list of the five best premises as one text."""
    top = V.reciprocal_rank_fusion([_symbolic(spark, d, 20), _dense(spark, d, 20)], "qid", "name", 5).join(table(spark, d, "corpus").select("name", "type_expr"), "name")
    line = F.concat((F.col("rank") + 1).cast("string"), F.lit(". "), "name", F.lit(" : "), "type_expr")
    g = top.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return g.select("qid", F.array_join("l.line", "\n").alias("context"))


@query("WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS qid, d.vec_id AS name, q.label AS ql, d.label AS dl, round(list_inner_product(q.e, d.e), 6) AS score FROM v q JOIN v d ON q.vec_id % 100 = 0), n AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, name) <= 50) SELECT qid, name, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, name) - 1 AS rank FROM n WHERE ql <> dl QUALIFY rank < 7")
def hard_negatives(spark, d):
    """The seven nearest of the 50 nearest vectors that do not share the query's label."""
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding", F.col("label").alias("ql"))
    near = V.dense_topk(q, "qid", v.select(F.col("vec_id").alias("name"), "embedding"), "name", "embedding", 50)
    labels = v.select(F.col("vec_id").alias("name"), F.col("label").alias("dl"))
    same = near.join(labels, "name").join(q.select("qid", "ql"), "qid").where("ql = dl").select("qid", "name")
    return V.hard_negatives(near, same, "qid", "name", 7).select("qid", "name", "score", "rank")


@query("WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS qid, d.vec_id AS name FROM v q JOIN v d ON q.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.e, d.e), 6) DESC, d.vec_id) = 1) SELECT count(*) AS queries, round(avg(CASE WHEN qid = name THEN 1 ELSE 0 END), 6) AS recall_at_1 FROM s")
def self_recall(spark, d):
    """Self-retrieval: how often a vector's nearest neighbour is itself."""
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    top = V.dense_topk(q, "qid", v.select(F.col("vec_id").alias("name"), "embedding"), "name", "embedding", 1)
    return top.agg(F.count("*").alias("queries"), F.round(F.avg((F.col("qid") == F.col("name")).cast("int")), 6).alias("recall_at_1"))


@query()
def cell_index_recall(spark, d):
    """Recall at 10 of the cell index, written and read again, against brute force."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("name"), "embedding")
    q = v.where("name % 100 = 0").select(F.col("name").alias("qid"), "embedding")
    index = V.build_index(v, "name", "embedding", shared_path(spark, "cell-index"), flat_below=0)
    return V.recall(V.search(q, "qid", "embedding", index, 10), V.dense_topk(q, "qid", v, "name", "embedding", 10), "qid", "name")


@query("WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id, round(sqrt(list_inner_product(e, e)), 5) AS norm FROM e")
def vector_norms(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.round(F.sqrt(V.inner_product(F.col("embedding"), F.col("embedding"))), 5).alias("norm"))


@query("SELECT name, 'passage: ' || name || ' : ' || CASE WHEN length(type_expr) > 512 THEN substr(type_expr, 1, 512) || '...' ELSE type_expr END AS encoded FROM corpus")
def encode_text(spark, d):
    return table(spark, d, "corpus").select("name", F.concat(F.lit("passage: "), "name", F.lit(" : "), X.truncated(F.col("type_expr"), 512)).alias("encoded"))


@query()
def contrastive_samples(spark, d):
    """Every step's state with each premise its tactic cites and the seven nearest other premises, with train/val/test by full theorem name.

    Equal states are searched once. States without an identifier have no vector and give no sample, as samples without negatives are dropped.
    """
    from tacticmill.operators.windows import ratio_split
    from tacticmill.plans.join_plans import _premises

    cited, resolved = _premises(spark, d)
    pos = cited.join(resolved, "cited").select("cos_id", "step_index", F.md5("state_before").alias("sid"), F.col("state_before").alias("text"), F.col("target").alias("name")).distinct()
    pos = cut(pos, "positive-pairs")
    q = cut(V.hashed_vectors(pos.groupBy("sid").agg(F.first("text").alias("text")), "sid", "text"), "query-vectors")
    v = cut(V.hashed_vectors(table(spark, d, "corpus").select("name", "type_expr"), "name", "type_expr"), "corpus-vectors")
    near = V.dense_topk(q, "sid", v, "name", "v", 50).groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("near"))
    queries = pos.groupBy("cos_id", "step_index", "sid").agg(F.collect_set("name").alias("positives")).join(near, "sid")
    queries = queries.withColumn("n", F.slice(F.array_except("near.name", "positives"), 1, 7)).where(F.size("n") > 0)
    theorem = F.coalesce("theorem_full_name", F.concat(F.lit("\n"), F.col("cos_id").cast("string"))).alias("theorem")
    chains = records(spark, d, "cos_records", "theorem_full_name").select("cos_id", theorem)
    parts = chains.join(ratio_split(chains, "theorem", {"train": 0.8, "val": 0.1, "test": 0.1}), "theorem").select("cos_id", "split")
    samples = queries.join(parts, "cos_id").select(F.concat_ws("-", "cos_id", "step_index").alias("qid"), F.explode("positives").alias("positive"), "n", "split")
    return samples.select("qid", "positive", F.array_join("n", ",").alias("negatives"), F.size("n").alias("num_negatives"), "split")
