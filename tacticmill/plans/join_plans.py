"""Lookup joins, set operations, sampling and augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tacticmill.functions import text as X
from tacticmill.operators import joins as J
from tacticmill.operators import windows as W
from tacticmill.plans.base import COS, ERR, FIRST, REF, STEPS, STRIP, hash_number_sql, query, records, steps, table

_TIERS = f"""{COS},
full_names AS (SELECT theorem_full_name AS k, cos_id FROM cos WHERE theorem_full_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY theorem_full_name ORDER BY cos_id DESC) = 1),
mids AS (SELECT array_to_string(list_slice(string_split(theorem_full_name, '.'), -2, -1), '.') AS k, cos_id FROM cos WHERE theorem_full_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY cos_id) = 1),
shorts AS (SELECT theorem_name AS k, cos_id FROM cos WHERE theorem_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY theorem_name ORDER BY cos_id) = 1)"""


@query(
    f"""WITH {ERR}, {_TIERS}, t AS (SELECT DISTINCT theorem_full_name, theorem_name FROM err WHERE theorem_full_name IS NOT NULL)
SELECT t.theorem_full_name, t.theorem_name, coalesce(f.cos_id, m.cos_id, s.cos_id) AS cos_id, CASE WHEN f.cos_id IS NOT NULL THEN 'full' WHEN m.cos_id IS NOT NULL THEN 'mid' WHEN s.cos_id IS NOT NULL THEN 'short' ELSE 'none' END AS tier
FROM t LEFT JOIN full_names f ON f.k = t.theorem_full_name LEFT JOIN mids m ON m.k = array_to_string(list_slice(string_split(t.theorem_full_name, '.'), -2, -1), '.') LEFT JOIN shorts s ON s.k = t.theorem_name"""
)
def fallback_lookup(spark, d):
    """Theorems of the error table to their chain by full name (last wins), last two segments or short name (first wins)."""
    t = records(spark, d, "error_records", "theorem_full_name", "theorem_name").where("theorem_full_name is not null").select("theorem_full_name", "theorem_name").distinct()
    c = records(spark, d, "cos_records", "theorem_full_name", "theorem_name")
    full = J.latest(c.where("theorem_full_name is not null").select(F.col("theorem_full_name").alias("k1"), F.col("cos_id").alias("c1")), ["k1"], ["c1"])
    mid = W.keep_first(c.where("theorem_full_name is not null").select(X.last_segments(F.col("theorem_full_name"), 2).alias("k2"), F.col("cos_id").alias("c2")), ["k2"], ["c2"])
    short = W.keep_first(c.where("theorem_name is not null").select(F.col("theorem_name").alias("k3"), F.col("cos_id").alias("c3")), ["k3"], ["c3"])
    j = t.join(full, t.theorem_full_name == F.col("k1"), "left").join(mid, X.last_segments(F.col("theorem_full_name"), 2) == F.col("k2"), "left").join(short, F.col("theorem_name") == F.col("k3"), "left")
    tier = F.when(F.col("c1").isNotNull(), "full").when(F.col("c2").isNotNull(), "mid").when(F.col("c3").isNotNull(), "short").otherwise("none")
    return j.select("theorem_full_name", "theorem_name", F.coalesce("c1", "c2", "c3").alias("cos_id"), tier.alias("tier"))


def _premises(spark, d):
    s = steps(spark, d).select("cos_id", "step_index", "state_before", F.explode(X.premises(F.col("tactic"))).alias("cited"))
    keys = J.corpus_keys(table(spark, d, "corpus").select("name"), "name", ["name"])
    return s, J.resolve_names(s, "cited", keys)



def _cited_sql() -> str:
    quoted = [p.replace("'", "''") for p in X.SINGLE_CITATIONS]
    single = " || ".join(f"list_transform(regexp_extract_all(t, '{p}', 1), lambda n: regexp_replace(n, '^@+', ''))" for p in quoted)
    # items of lists; a comma inside brackets opens no item
    flat = r"regexp_replace(g, '\([^()]*\)|\{[^{}]*\}|⟨[^⟨⟩]*⟩', '', 'g')"
    items = " || ".join(f"flatten(list_transform(regexp_extract_all(t, '{p}', 1), lambda g: string_split({flat}, ',')))" for p in X.LIST_CITATIONS)
    head = r"regexp_extract(regexp_replace(" + STRIP.format("s") + r", '^[←]*-*\s*@*', ''), '^([A-Z][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)', 1)"
    known = f"length(p) >= 2 AND NOT list_contains({X.NOT_PREMISES}, p) AND NOT (p = lower(p) AND regexp_matches(p, '[a-z]') AND NOT contains(p, '.')) AND NOT regexp_matches(p, '^[0-9]+$')"
    return f"""WITH {STEPS}, a AS (SELECT cos_id, step_index, coalesce(tactic, '') AS t FROM steps)
SELECT cos_id, step_index, unnest(list_distinct(list_filter({single} || list_transform({items}, lambda s: {head}), lambda p: {known}))) AS premise FROM a"""


@query(_cited_sql())
def cited_premises(spark, d):
    """Premises that each tactic cites; parsed by pattern and tested on cases."""
    return steps(spark, d).select("cos_id", "step_index", F.explode(X.premises(F.col("tactic"))).alias("premise"))


@query(
    f"""WITH {STEPS}, p AS (SELECT DISTINCT unnest(regexp_extract_all(tactic, '[A-Z][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)+')) AS cited FROM steps),
k AS (SELECT name AS target, 'exact' AS kind, name AS key FROM corpus UNION ALL SELECT name, 'short', string_split(name, '.')[-1] FROM corpus WHERE len(string_split(name, '.')) >= 2
UNION ALL SELECT name, 'short', array_to_string(list_slice(string_split(name, '.'), -2, -1), '.') FROM corpus WHERE len(string_split(name, '.')) >= 3),
keys AS (SELECT kind, key, min(target) AS target FROM k GROUP BY 1, 2),
c AS (SELECT cited, 0 AS prio, 'exact' AS kind, cited AS key FROM p UNION ALL SELECT cited, i, 'short', array_to_string(string_split(cited, '.')[i:], '.') FROM p, unnest(range(1, len(string_split(cited, '.')) + 1)) t(i))
SELECT cited, arg_min(target, prio) AS target FROM c JOIN keys USING (kind, key) GROUP BY cited"""
)
def resolved_premises(spark, d):
    """Dotted names cited by tactics to corpus names: exact, then short keys of ever shorter suffixes."""
    cited = steps(spark, d).select(F.explode(F.regexp_extract_all("tactic", F.lit(r"([A-Z][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+)"), 1)).alias("cited"))
    return J.resolve_names(cited, "cited", J.corpus_keys(table(spark, d, "corpus").select("name"), "name", ["name"]))


def _positive_sql() -> str:
    cited = _cited_sql()
    cited = cited[: cited.rindex("SELECT cos_id")].replace("coalesce(tactic, '') AS t FROM", "coalesce(tactic, '') AS t, state_before FROM")
    named = _cited_sql()[_cited_sql().rindex("SELECT cos_id") :].replace("SELECT cos_id, step_index,", "SELECT cos_id, step_index, state_before,", 1)
    return f"""{cited}, q AS ({named}), k AS (SELECT name AS target, 'exact' AS kind, name AS key FROM corpus UNION ALL SELECT name, 'short', string_split(name, '.')[-1] FROM corpus WHERE len(string_split(name, '.')) >= 2
UNION ALL SELECT name, 'short', array_to_string(list_slice(string_split(name, '.'), -2, -1), '.') FROM corpus WHERE len(string_split(name, '.')) >= 3),
keys AS (SELECT kind, key, min(target) AS target FROM k GROUP BY 1, 2), p AS (SELECT DISTINCT premise AS cited FROM q),
c AS (SELECT cited, 0 AS prio, 'exact' AS kind, cited AS key FROM p UNION ALL SELECT cited, i, 'short', array_to_string(string_split(cited, '.')[i:], '.') FROM p, unnest(range(1, len(string_split(cited, '.')) + 1)) t(i)),
r AS (SELECT cited, arg_min(target, prio) AS target FROM c JOIN keys USING (kind, key) GROUP BY cited),
o AS (SELECT cos_id, step_index, target, type_expr, md5(state_before || '|' || target) AS hash FROM q JOIN r ON r.cited = q.premise JOIN (SELECT name AS target, type_expr FROM corpus) USING (target) WHERE length(state_before) BETWEEN 20 AND 2048)
SELECT cos_id, step_index, target AS positive_name, target || ' : ' || type_expr AS positive_text, hash FROM o QUALIFY row_number() OVER (PARTITION BY hash ORDER BY cos_id, step_index) = 1"""


@query(_positive_sql())
def positive_pairs(spark, d):
    """States with the corpus text of each premise their tactic cites, one row for each premise, keep-first by hash."""
    cited, resolved = _premises(spark, d)
    pairs = cited.where(F.length("state_before").between(20, 2048)).join(resolved, "cited").join(table(spark, d, "corpus").select(F.col("name").alias("target"), "type_expr"), "target")
    pairs = pairs.withColumn("hash", F.md5(F.concat_ws("|", "state_before", "target")))
    return W.keep_first(pairs, ["hash"], ["cos_id", "step_index"]).select("cos_id", "step_index", F.col("target").alias("positive_name"), F.concat("target", F.lit(" : "), "type_expr").alias("positive_text"), "hash")


@query(
    f"""WITH {ERR}, {COS}, f AS (SELECT theorem_full_name, max(len(full_cos_chain)) AS n FROM cos GROUP BY 1), s AS (SELECT theorem_name, arg_min(theorem_full_name, cos_id) AS theorem_full_name FROM cos WHERE theorem_name IS NOT NULL GROUP BY 1)
SELECT CASE WHEN f.n IS NOT NULL THEN 'full' WHEN g.n IS NOT NULL THEN 'short' ELSE 'unmatched' END AS how, count(*) AS errors FROM err e LEFT JOIN f ON f.theorem_full_name = e.theorem_full_name LEFT JOIN s ON s.theorem_name = e.theorem_name LEFT JOIN f g ON g.theorem_full_name = s.theorem_full_name GROUP BY 1"""
)
def errors_to_steps(spark, d):
    """How errors find the steps of their theorem: by full name, by short name (first wins), or not."""
    c = records(spark, d, "cos_records", "theorem_full_name", "theorem_name", "full_cos_chain").withColumn("n", F.size("full_cos_chain"))
    full = c.groupBy(F.col("theorem_full_name").alias("k1")).agg(F.max("n").alias("n1"))
    short = c.where("theorem_name is not null").groupBy(F.col("theorem_name").alias("k2")).agg(F.min_by("theorem_full_name", "cos_id").alias("f2"))
    e = records(spark, d, "error_records", "theorem_full_name", "theorem_name")
    j = e.join(full, e.theorem_full_name == F.col("k1"), "left").join(short, F.col("theorem_name") == F.col("k2"), "left").join(full.select(F.col("k1").alias("k3"), F.col("n1").alias("n3")), F.col("f2") == F.col("k3"), "left")
    how = F.when(F.col("n1").isNotNull(), "full").when(F.col("n3").isNotNull(), "short").otherwise("unmatched")
    return j.groupBy(how.alias("how")).agg(F.count("*").alias("errors"))


@query(
    f"""WITH {ERR}, {STEPS}, k AS (SELECT tactic, substr(state_before, 1, 100) AS head, max(cos_id * 1000 + step_index) AS last FROM steps GROUP BY 1, 2)
SELECT error_id, last // 1000 AS cos_id, last % 1000 AS found_step FROM err JOIN k ON k.tactic = original_tactic AND k.head = substr(err.state_before, 1, 100) WHERE err.step_index IS NULL OR err.step_index < 0"""
)
def step_by_content(spark, d):
    """Errors without a usable step index find their step by tactic and the head of the state; the last wins."""
    k = steps(spark, d).groupBy("tactic", F.substring("state_before", 1, 100).alias("head")).agg(F.max(F.col("cos_id") * 1000 + F.col("step_index")).alias("last"))
    e = records(spark, d, "error_records", "original_tactic", "state_before", "step_index").where("step_index is null or step_index < 0")
    e = e.select("error_id", F.col("original_tactic").alias("tactic"), F.substring("state_before", 1, 100).alias("head"))
    return e.join(k, ["tactic", "head"]).select("error_id", F.floor(F.col("last") / 1000).alias("cos_id"), (F.col("last") % 1000).alias("found_step"))


@query(
    f"""WITH {ERR}, {STEPS}, c AS (SELECT theorem_full_name, min(cos_id) AS cos_id FROM cos WHERE theorem_full_name <> '_example' GROUP BY 1), s AS (SELECT cos_id, array_agg(tactic ORDER BY step_index) AS v FROM steps GROUP BY 1)
SELECT error_id, CAST(least(len(v), step_index) AS INTEGER) AS n, md5(array_to_string(v[1:step_index], '|')) AS replay FROM err JOIN c USING (theorem_full_name) JOIN s USING (cos_id) WHERE step_index >= 0"""
)
def prefix_replay(spark, d):
    """All tactics before an error's step, by slicing one ordered array for each chain; named theorems only, as its SQL form says. `error_replays` has every error."""
    s = steps(spark, d)
    chosen = s.where("theorem_full_name <> '_example'").groupBy("theorem_full_name").agg(F.min("cos_id").alias("cos_id"))
    arrays = chosen.join(J.prefix(s, "cos_id", "step_index", "tactic"), "cos_id")
    e = records(spark, d, "error_records", "theorem_full_name", "step_index").where("step_index >= 0")
    p = F.expr("slice(values, 1, step_index)")
    return e.join(arrays, "theorem_full_name").select("error_id", F.size(p).alias("n"), F.md5(F.array_join(p, "|")).alias("replay"))


def _replays(spark, d, *columns):
    s = steps(spark, d)
    e = J.replay_chains(records(spark, d, "error_records", "theorem_full_name", "step_index", "original_tactic", "state_before", *columns), s)
    e = e.join(J.prefix(s, "cos_id", "step_index", "tactic"), "cos_id", "left")
    return e.withColumn("replay", F.expr("slice(values, 1, step)")).drop("values")


@query()
def error_replays(spark, d):
    """Every error with the tactics before its step, or the status that says why there are none (`ambiguous`, `step_not_found`, `no_steps`)."""
    e = _replays(spark, d)
    return e.select("error_id", "cos_id", F.coalesce("status", F.lit("found")).alias("status"), F.when(F.col("cos_id").isNotNull(), F.size("replay")).alias("n"), F.md5(F.array_join("replay", "|")).alias("replay"))


@query(f"WITH {ERR}, {REF} SELECT error_id FROM err WHERE error_id NOT IN (SELECT error_id FROM ref)")
def resume_anti_join(spark, d):
    """Errors that have no reflection yet."""
    return J.resume(records(spark, d, "error_records", "error_type"), table(spark, d, "reflection_records"), ["error_id"]).select("error_id")


@query(f"WITH {ERR}, {COS} SELECT error_id FROM err WHERE theorem_full_name IS NOT NULL AND theorem_full_name NOT IN (SELECT theorem_full_name FROM cos WHERE split IN ('val', 'test'))")
def held_out_blacklist(spark, d):
    bad = table(spark, d, "cos_records").where(F.col("split").isin("val", "test"))
    return J.resume(records(spark, d, "error_records", "theorem_full_name").where("theorem_full_name is not null"), bad, ["theorem_full_name"]).select("error_id")


@query("SELECT e.vec_id, p.p_name AS name FROM embeddings e JOIN part p ON p.p_partkey = e.vec_id WHERE e.vec_id >= 0")
def vector_metadata(spark, d):
    """Vector ids to their metadata row; ids out of range find none."""
    v = table(spark, d, "embeddings").select("vec_id").where("vec_id >= 0")
    return v.join(table(spark, d, "part").select(F.col("p_partkey").alias("vec_id"), F.col("p_name").alias("name")), "vec_id")


@query(
    """WITH r AS (SELECT o_custkey AS g, o_orderkey AS rid, CAST(floor(o_totalprice / 1000) AS BIGINT) AS lo, CAST(floor(o_totalprice / 1000) AS BIGINT) + 20 AS hi FROM orders), p AS (SELECT DISTINCT o_custkey AS g, CAST(floor(o_totalprice / 700) AS BIGINT) AS x FROM orders)
SELECT g, x, rid FROM p JOIN r USING (g) WHERE x BETWEEN lo AND hi QUALIFY row_number() OVER (PARTITION BY g, x ORDER BY lo, rid) = 1"""
)
def range_lookup(spark, d):
    """First closed range that covers a line, inside the same file (here: the same customer)."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("rid"), "o_totalprice")
    ranges = o.select("g", "rid", F.floor(F.col("o_totalprice") / 1000).alias("lo"), (F.floor(F.col("o_totalprice") / 1000) + 20).alias("hi"))
    points = o.select("g", F.floor(F.col("o_totalprice") / 700).alias("x")).distinct()
    return J.interval_lookup(points, "x", ranges, "lo", "hi", "g", ["lo", "rid"], 20).select("g", "x", "rid")


# ---- set operations


@query(
    f"""WITH {COS}, {ERR}, u AS (SELECT 'chain' AS kind, cos_id AS id, theorem_full_name, NULL AS error_type, NULL AS source FROM cos UNION ALL SELECT 'error', error_id, theorem_full_name, error_type, source FROM err) SELECT kind, id, theorem_full_name, error_type, coalesce(source, 'original') AS source FROM u"""
)
def mixed_union(spark, d):
    """Rows of different shape under one schema, with a default source."""
    a = records(spark, d, "cos_records", "theorem_full_name").select(F.lit("chain").alias("kind"), F.col("cos_id").alias("id"), "theorem_full_name")
    b = records(spark, d, "error_records", "theorem_full_name", "error_type", "source").select(F.lit("error").alias("kind"), F.col("error_id").alias("id"), "theorem_full_name", "error_type", "source")
    return a.unionByName(b, allowMissingColumns=True).withColumn("source", F.coalesce("source", F.lit("original")))


@query(
    f"""WITH {COS}, u AS (SELECT 0 AS prio, name, type_expr FROM corpus UNION ALL SELECT 1, theorem_full_name, arg_min(theorem_type, cos_id) FROM cos WHERE theorem_full_name IS NOT NULL GROUP BY 2) SELECT name, arg_min(type_expr, prio) AS type_expr, min(prio) AS prio FROM u GROUP BY name"""
)
def union_by_name(spark, d):
    """Union of two corpora by name; the left one wins."""
    a = table(spark, d, "corpus").select(F.lit(0).alias("prio"), "name", "type_expr")
    c = records(spark, d, "cos_records", "theorem_full_name", "theorem_type").where("theorem_full_name is not null")
    b = c.groupBy("theorem_full_name").agg(F.min_by("theorem_type", F.when(F.col("theorem_type").isNotNull(), F.col("cos_id"))).alias("type_expr")).select(F.lit(1).alias("prio"), F.col("theorem_full_name").alias("name"), "type_expr")
    return a.union(b).groupBy("name").agg(F.min_by("type_expr", F.when(F.col("type_expr").isNotNull(), F.col("prio"))).alias("type_expr"), F.min("prio").alias("prio"))


@query(f"WITH {REF}, b AS (SELECT DISTINCT CAST({hash_number_sql('CAST(record_id AS VARCHAR)')} % 9 AS INTEGER) AS batch FROM ref) SELECT CAST(i AS INTEGER) AS missing FROM range(12) t(i) WHERE i NOT IN (SELECT batch FROM b)")
def missing_batches(spark, d):
    """Expected batches without output."""
    have = table(spark, d, "reflection_records").select((X.hash_number(F.col("record_id").cast("string")) % 9).cast("int").alias("missing")).distinct()
    return spark.range(12).select(F.col("id").cast("int").alias("missing")).join(have, "missing", "left_anti")


@query("SELECT name, len(list_distinct(regexp_extract_all(type_expr, '[A-Za-z_][\\pL\\pN_.]*'))) AS tokens, len(list_intersect(list_distinct(regexp_extract_all(type_expr, '[A-Za-z_][\\pL\\pN_.]*')), list_distinct(regexp_extract_all(coalesce(doc_text, ''), '[A-Za-z_][\\pL\\pN_.]*')))) AS shared FROM corpus")
def token_sets(spark, d):
    a, b = X.identifiers(F.col("type_expr")), X.identifiers(F.col("doc_text"))
    return table(spark, d, "corpus").select("name", F.size(a).cast("long").alias("tokens"), F.size(F.array_intersect(a, b)).cast("long").alias("shared"))


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def concatenated(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return a.unionByName(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))


@query(
    f"""WITH {COS}, a AS (SELECT cos_id, list_filter([file_path, theorem_name, 'Init', theorem_name], lambda x: x IS NOT NULL) AS l FROM cos)
SELECT cos_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ';') AS paths FROM a"""
)
def path_merge(spark, d):
    """Order-preserving distinct of merged path lists."""
    r = records(spark, d, "cos_records", "file_path", "theorem_name")
    merged = F.flatten(F.array(F.array_compact(F.array("file_path", "theorem_name")), F.array_compact(F.array(F.lit("Init"), F.col("theorem_name")))))
    return r.select("cos_id", F.array_join(F.array_distinct(merged), ";").alias("paths"))
