"""Chains, filters and order-dependent operators on the proof tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tacticmill.functions import text as X
from tacticmill.operators import chains as C
from tacticmill.operators import filters as P
from tacticmill.operators import windows as W
from tacticmill.plans.base import COS, ERR, FIRST, REF, STEPS, STRIP, hash_number_sql, query, records, steps, table

_KEYS_SQL = "('have','apply','rw','simp','exact','intro','cases','induction','constructor','refine','calc','obtain')"
_INDICES = f"""
WITH {COS}, a AS (SELECT cos_id, full_cos_chain AS chain, len(full_cos_chain) AS n, range(0, len(full_cos_chain)) AS every FROM cos),
b AS (SELECT *, greatest(n // 3, 3) AS target, list_filter(every, lambda i: i = 0 OR i = n - 1 OR {FIRST.format('chain[i + 1].tactic')} IN {_KEYS_SQL}) AS marked FROM a),
c AS (SELECT *, CASE WHEN len(marked) > target THEN list_distinct(list_concat(list_filter(marked, lambda v, i: (i - 1) % greatest(len(marked) // target, 1) = 0), [0, n - 1])) ELSE marked END AS kept FROM b),
d AS (SELECT *, target - len(kept) AS need, list_filter(every, lambda i: NOT list_contains(kept, i)) AS rest FROM c),
e AS (SELECT cos_id, chain, n, CASE WHEN n = 0 THEN [] WHEN n <= 3 THEN every WHEN need > 0 THEN list_sort(list_distinct(list_concat(kept, list_filter(rest, lambda v, i: (i - 1) % greatest(len(rest) // need, 1) = 0)[1:need]))) ELSE list_sort(kept) END AS idx FROM d)
"""


@query(_INDICES + "SELECT cos_id, CAST(n AS INTEGER) AS full_steps, CAST(len(idx) AS INTEGER) AS key_steps, array_to_string(idx, ',') AS kept, round(len(idx) / greatest(n, 1), 6) AS compression_ratio FROM e")
def chain_compress(spark, d):
    """Which steps a compressed chain keeps, and its ratio."""
    r = C.with_key_indices(records(spark, d, "cos_records", "full_cos_chain"), "full_cos_chain").withColumn("full_steps", F.size("full_cos_chain"))
    return r.select("cos_id", "full_steps", F.size("idx").alias("key_steps"), F.array_join("idx", ",").alias("kept"), F.round(F.size("idx") / F.greatest("full_steps", F.lit(1)), 6).alias("compression_ratio"))


@query(
    _INDICES
    + """, f AS (SELECT cos_id, idx, chain, unnest(range(1, least(len(idx), 50) + 1)) AS j FROM e WHERE n >= 3)
SELECT cos_id, CAST(j - 1 AS INTEGER) AS step_index, CAST(least(len(idx), 50) AS INTEGER) AS total_steps, CAST(idx[j] AS INTEGER) AS full_index, chain[idx[j] + 1].tactic AS tactic,
sha256(coalesce(chain[idx[j] + 1].state_before, '') || '|' || coalesce(chain[idx[j] + 1].tactic, '') || '|' || coalesce(chain[idx[j] + 1].state_after, '')) AS hash FROM f"""
)
def chain_flatten(spark, d):
    """Scan, length gate, compression, flattening with both indices, row hash."""
    keep, cut = C.length_gate(F.col("idx"))
    r = records(spark, d, "cos_records", "full_cos_chain").where(F.size("full_cos_chain") >= 3).select("cos_id", F.col("full_cos_chain").alias("chain"))
    r = C.with_key_indices(r, "chain")
    r = r.where(keep).select("cos_id", "chain", cut.alias("idx"))
    flat = r.select("cos_id", "chain", F.size("idx").alias("total_steps"), F.posexplode("idx").alias("step_index", "full_index")).withColumn("s", F.get("chain", F.col("full_index")))
    return flat.select("cos_id", "step_index", "total_steps", "full_index", "s.tactic", X.fingerprint(F.col("s.state_before"), F.col("s.tactic"), F.col("s.state_after")).alias("hash"))


@query(f"WITH {COS} SELECT cos_id, proof_steps FROM cos WHERE proof_steps BETWEEN 2 AND 200 AND len(list_filter(full_cos_chain, lambda s: contains(s.tactic, 'sorry') OR contains(s.tactic, 'native_decide'))) = 0")
def valid_proofs(spark, d):
    r = records(spark, d, "cos_records", "proof_steps", "full_cos_chain")
    return r.where(P.usable_proof(F.col("proof_steps"), F.col("full_cos_chain.tactic"))).select("cos_id", "proof_steps")


@query(f"WITH {COS} SELECT cos_id, len(full_cos_chain) AS n FROM cos WHERE len(full_cos_chain) > 0 AND metadata.has_leandojo_trace")
def traced_chains(spark, d):
    r = records(spark, d, "cos_records", "full_cos_chain", "metadata")
    return r.where((F.size("full_cos_chain") > 0) & F.col("metadata.has_leandojo_trace")).select("cos_id", F.size("full_cos_chain").cast("long").alias("n"))


@query(f"WITH {STEPS} SELECT cos_id, step_index, tactic FROM steps WHERE NOT starts_with(coalesce(state_before, ''), '[state_')")
def without_placeholders(spark, d):
    return steps(spark, d).where(~X.text(F.col("state_before")).startswith("[state_")).select("cos_id", "step_index", "tactic")


@query(
    f"""WITH {STEPS} SELECT cos_id, count(*) AS n, count(*) FILTER (WHERE coalesce(state_before, '') <> '' AND coalesce(tactic, '') <> '' AND NOT starts_with(state_before, '[state_')
AND NOT (coalesce(state_before, '') = coalesce(state_after, '') AND tactic NOT IN ('skip', 'rfl'))) AS valid FROM steps GROUP BY cos_id"""
)
def step_validity(spark, d):
    ok = C.valid_step(F.col("state_before"), F.col("tactic"), F.col("state_after"))
    return steps(spark, d).groupBy("cos_id").agg(F.count("*").alias("n"), F.count_if(ok).alias("valid"))


@query(
    f"""WITH {ERR} SELECT CASE WHEN coalesce(thought, '') = '' THEN 'thought' WHEN coalesce(original_tactic, '') = '' THEN 'tactic' WHEN coalesce(state_before, '') = '' THEN 'state_before'
WHEN coalesce(state_after, '') = '' THEN 'state_after' WHEN {STRIP.format('original_tactic')} = 'sorry' THEN 'sorry' ELSE 'kept' END AS reason, count(*) AS n FROM err GROUP BY 1"""
)
def bad_records(spark, d):
    r = records(spark, d, "error_records", "thought", "original_tactic", "state_before", "state_after")
    return P.dropped(r, P.bad_record(F.col("thought"), F.col("original_tactic"), F.col("state_before"), F.col("state_after")))


_FORBIDDEN, _NEEDED = ["As an AI", "I cannot", "TODO"], ["goal", "⊢", "use", "apply", "rewrit", "hypothes"]


@query(
    f"""WITH {ERR} SELECT error_id FROM err WHERE length(thought) BETWEEN 20 AND 500 AND NOT ({' OR '.join(f"contains(thought, '{p}')" for p in _FORBIDDEN)}) AND ({' OR '.join(f"contains(thought, '{w}')" for w in _NEEDED)})"""
)
def thought_quality(spark, d):
    return records(spark, d, "error_records", "thought").where(P.text_quality(F.col("thought"), _FORBIDDEN, _NEEDED)).select("error_id")


@query(
    f"""WITH {ERR}, a AS (SELECT *, starts_with(coalesce(verification_status, ''), 'verified') AS ok FROM err) SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS after_status,
count(*) FILTER (WHERE ok AND {STRIP.format("coalesce(error_message, '')")} <> '' AND {STRIP.format("coalesce(state_before, '')")} <> '' AND {STRIP.format("coalesce(original_tactic, '')")} <> '') AS after_fields FROM a"""
)
def status_filter(spark, d):
    r = records(spark, d, "error_records", "verification_status", "error_message", "state_before", "original_tactic")
    ok, have = P.status_ok(F.col("verification_status")), P.required("error_message", "state_before", "original_tactic")
    return r.agg(F.count("*").alias("total"), F.count_if(ok).alias("after_status"), F.count_if(ok & have).alias("after_fields"))


@query(f"WITH {REF} SELECT record_id FROM ref WHERE length(reflection) BETWEEN 50 AND 2000 AND NOT (contains(lower(reflection), 'as an ai') OR contains(lower(reflection), 'i cannot'))")
def reflection_quality(spark, d):
    return records(spark, d, "reflection_records", "reflection").where(P.text_quality(F.col("reflection"), ["as an AI", "I cannot"], [], 50, 2000, True)).select("record_id")




def _ids_sql(col: str) -> str:
    """tactic_identifiers in DuckDB, over a stripped text."""
    words = f"list_filter(list_transform(regexp_split_to_array(regexp_replace({col}, '[\\[\\]]', ' ', 'g'), '\\s+'), lambda w: regexp_replace(w, '^[(),;]+|[(),;]+$', '', 'g')), lambda w: w <> '')"
    inside = f"flatten(list_transform(regexp_extract_all({col}, '\\[([^\\]]+)\\]', 1), lambda b: string_split(b, ',')))"
    bracket = f"list_filter(list_transform({inside}, lambda p: regexp_replace({STRIP.format('p')}, '^[←↔]\\s*', '')), lambda p: length(p) > 2)"
    dotted = f"list_filter({words}, lambda w: length(w) > 2 AND contains(w, '.') AND NOT starts_with(w, '-'))"
    plain = f"list_filter({words}, lambda w: length(w) > 2 AND lower(w) NOT IN ({', '.join(repr(t) for t in X.TACTIC_WORDS)}))[1:1]"
    return f"CASE WHEN len(list_concat({bracket}, {dotted})) > 0 THEN list_concat({bracket}, {dotted}) WHEN len({plain}) > 0 THEN {plain} WHEN {col} <> '' THEN [{col}] ELSE [] END"


@query(
    f"""WITH {REF}, a AS (SELECT record_id, reflection, lower(reflection) AS low, error_type, {STRIP.format("coalesce(original_tactic, '')")} AS o, {STRIP.format("coalesce(error_tactic, '')")} AS e FROM ref),
b AS (SELECT *, {_ids_sql('o')} AS oi, {_ids_sql('e')} AS ei, CASE error_type {' '.join(f"WHEN '{k}' THEN {ws}" for k, ws in P.TYPE_WORDS.items())} ELSE [coalesce(error_type, '')] END AS kinds FROM a)
SELECT record_id, coalesce(o = '' OR contains(reflection, o) OR len(list_filter(oi, lambda x: contains(low, lower(x)))) > 0
OR (e <> '' AND (contains(reflection, e) OR len(list_filter(ei, lambda x: contains(low, lower(x)))) > 0) AND len(list_filter(kinds, lambda x: contains(low, lower(x)))) > 0), false) AS consistent FROM b"""
)
def reflection_consistency(spark, d):
    r = records(spark, d, "reflection_records", "reflection", "original_tactic", "error_tactic", "error_type")
    return r.select("record_id", P.consistent(F.col("reflection"), F.col("original_tactic"), F.col("error_tactic"), F.col("error_type")).alias("consistent"))


@query(f"SELECT name, type_expr FROM corpus WHERE {STRIP.format('name')} <> '' AND {STRIP.format('type_expr')} <> ''")
def corpus_gate(spark, d):
    return table(spark, d, "corpus").where(P.required("name", "type_expr")).select("name", "type_expr")


@query(f"WITH {STEPS} SELECT CASE WHEN state_before IS NULL OR length(state_before) < 20 THEN 'too_short' WHEN length(state_before) > 2048 THEN 'too_long' ELSE 'kept' END AS reason, count(*) AS n FROM steps GROUP BY 1")
def state_length_gate(spark, d):
    n = F.length("state_before")
    return P.dropped(steps(spark, d), F.when(F.col("state_before").isNull() | (n < 20), "too_short").when(n > 2048, "too_long"))


@query(
    f"""WITH {ERR}, a AS (SELECT error_id, list_distinct(list_filter([{STRIP.format('original_tactic')}, regexp_replace({STRIP.format('error_tactic')}, '^:\\s*', ''), {STRIP.format('original_tactic')}],
lambda t: t <> '' AND t NOT IN ('sorry', 'admit') AND NOT regexp_full_match(t, '\\[?(Thought|Tactic|Error Tactic)\\]?:?'))) AS c FROM err)
SELECT error_id, CAST(len(c) AS INTEGER) AS n, array_to_string(list_sort(c), ' ;; ') AS candidates FROM a"""
)
def candidate_noise(spark, d):
    r = records(spark, d, "error_records", "original_tactic", "error_tactic")
    raw = F.array(X.strip(F.col("original_tactic")), F.regexp_replace(X.strip(F.col("error_tactic")), r"^:\s*", ""), X.strip(F.col("original_tactic")))
    kept = F.array_distinct(F.filter(raw, lambda t: (t != "") & ~t.isin("sorry", "admit") & ~t.rlike(r"^\[?(Thought|Tactic|Error Tactic)\]?:?$")))
    return r.select("error_id", F.size(kept).alias("n"), F.array_join(F.array_sort(kept), " ;; ").alias("candidates"))


@query(f"WITH {ERR} SELECT error_id FROM err WHERE source = 'synthetic'")
def source_split(spark, d):
    return records(spark, d, "error_records", "source").where("source = 'synthetic'").select("error_id")


_FIELDS = ["thought", "repair_hint", "error_message", "state_before", "state_after", "source", "step_index"]


@query(" UNION ALL ".join(f"SELECT '{f}' AS field, count(*) FILTER (WHERE coalesce(CAST({f} AS VARCHAR), '') <> '') AS present, count(*) FILTER (WHERE coalesce(CAST({f} AS VARCHAR), '') = '') AS missing FROM (WITH {ERR} SELECT * FROM err)" for f in _FIELDS))
def field_completeness(spark, d):
    return P.completeness(records(spark, d, "error_records", *_FIELDS), _FIELDS)


@query(f"WITH {REF} SELECT record_id, CASE WHEN length(state_before) > 100 THEN substr(state_before, 1, 100) || '...' ELSE state_before END AS state, CASE WHEN length(reflection) > 200 THEN substr(reflection, 1, 200) || '... (truncated)' ELSE reflection END AS short FROM ref")
def text_truncation(spark, d):
    r = records(spark, d, "reflection_records", "state_before", "reflection")
    return r.select("record_id", X.truncated(F.col("state_before"), 100).alias("state"), X.truncated(F.col("reflection"), 200, "... (truncated)").alias("short"))


@query(
    f"""WITH {COS}, a AS (SELECT cos_id, list_transform(full_cos_chain, lambda s: s.tactic) AS t, list_transform(full_cos_chain, lambda s: s.state_before) AS s FROM cos WHERE len(full_cos_chain) >= 2),
b AS (SELECT cos_id, unnest(range(1, len(t) + 1)) AS i, t, s FROM a)
SELECT cos_id, CAST(i - 1 AS INTEGER) AS step_index, md5(t[i]) AS tactic, md5(s[i]) AS before, md5(coalesce(s[i + 1], 'no goals')) AS after FROM b WHERE coalesce(t[i], '') NOT IN ('', 'sorry', 'admit') AND coalesce(s[i], '') <> ''"""
)
def trajectory_steps(spark, d):
    """Runs as (state, tactic, next state); the last next state is that nothing is left."""
    r = records(spark, d, "cos_records", "full_cos_chain").where(F.size("full_cos_chain") >= 2)
    runs = r.select("cos_id", F.posexplode(C.consecutive_states(F.col("full_cos_chain.tactic"), F.col("full_cos_chain.state_before"))).alias("step_index", "s"))
    runs = runs.where(~X.text(F.col("s.tactic")).isin("", "sorry", "admit") & (X.text(F.col("s.state_before")) != ""))
    return runs.select("cos_id", "step_index", F.md5("s.tactic").alias("tactic"), F.md5("s.state_before").alias("before"), F.md5("s.state_after").alias("after"))


@query(
    f"""WITH {COS}, a AS (SELECT cos_id, CASE WHEN len(full_cos_chain) > 0 AND metadata.has_leandojo_trace THEN list_transform(full_cos_chain, lambda s: s.state_before) ELSE list_transform(range(0, len(full_cos_chain)), lambda i: '[state_' || i || ']') END AS s FROM cos)
SELECT cos_id, CAST(len(s) AS INTEGER) AS n, md5(array_to_string(s, '|')) AS states FROM a"""
)
def chain_build(spark, d):
    """Traced chains as they are; untraced ones with numbered stand-ins around each tactic."""
    r = records(spark, d, "cos_records", "full_cos_chain", "metadata")
    states = F.when(F.col("metadata.has_leandojo_trace"), F.col("full_cos_chain")).otherwise(F.slice("full_cos_chain", 1, 0))
    chain = C.full_chain(states, F.col("full_cos_chain.tactic"))
    return r.select("cos_id", F.size(chain).alias("n"), F.md5(F.array_join(F.transform(chain, lambda s: s["state_before"]), "|")).alias("states"))


# ---- order-dependent


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) = 1")
def keep_first_rows(spark, d):
    return W.keep_first(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    f"""WITH {ERR} SELECT error_id FROM err QUALIFY row_number() OVER (PARTITION BY sha256(coalesce(theorem_full_name, '') || '|' || coalesce(CAST(step_index AS VARCHAR), '') || '|' || coalesce(error_tactic, '') || '|' || coalesce(source, '')) ORDER BY error_id) = 1"""
)
def dedup_by_hash(spark, d):
    """Keep-first by the hash of joined fields; source and wrong tactic are part of the key, so variants do not collide."""
    r = records(spark, d, "error_records", "theorem_full_name", "step_index", "error_tactic", "source")
    r = r.withColumn("h", X.fingerprint(F.col("theorem_full_name"), F.col("step_index").cast("string"), F.col("error_tactic"), F.col("source")))
    return W.keep_first(r, ["h"], ["error_id"]).select("error_id")


@query(
    """SELECT l_orderkey, count(DISTINCT l_linenumber) AS n, CASE WHEN min(l_linenumber) IS NULL OR min(l_linenumber) <> 1 THEN 'incomplete' WHEN max(l_linenumber) - min(l_linenumber) + 1 <> count(DISTINCT l_linenumber) THEN 'gap' ELSE 'ok' END AS status FROM lineitem GROUP BY l_orderkey"""
)
def contiguity_check(spark, d):
    return W.contiguity(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber", base=1)


@query(
    f"""WITH {ERR}, g AS (SELECT theorem_full_name, CASE WHEN min(step_index) IS NULL OR min(step_index) <> 0 THEN 'incomplete' WHEN max(step_index) - min(step_index) + 1 <> count(DISTINCT step_index) THEN 'gap' ELSE 'ok' END AS status FROM err WHERE theorem_full_name IS NOT NULL GROUP BY 1)
SELECT error_id FROM err JOIN g USING (theorem_full_name) WHERE g.status = 'ok'"""
)
def clean_theorems(spark, d):
    """Rows of theorems whose steps start at 0 and have no gap."""
    r = records(spark, d, "error_records", "theorem_full_name", "step_index").where("theorem_full_name is not null")
    good = W.contiguity(r, "theorem_full_name", "step_index").where("status = 'ok'").select("theorem_full_name")
    return r.join(good, "theorem_full_name", "left_semi").select("error_id")


@query(f"WITH {STEPS} SELECT CASE WHEN step_index = 0 THEN 'first' WHEN step_index = total_steps - 1 THEN 'last' ELSE 'middle' END AS position, {FIRST.format('tactic')} AS head, count(*) AS n FROM steps GROUP BY 1, 2")
def position_classes(spark, d):
    s = steps(spark, d)
    return s.groupBy(W.position_class(F.col("step_index"), F.col("total_steps")).alias("position"), X.first_token(F.col("tactic")).alias("head")).agg(F.count("*").alias("n"))


@query(f"WITH {ERR} SELECT error_id, error_type FROM err QUALIFY row_number() OVER (PARTITION BY error_type ORDER BY error_id) <= 50")
def type_cap(spark, d):
    """First 50 records of each error type: the operator is the cap."""
    return W.keep_first(records(spark, d, "error_records", "error_type"), ["error_type"], ["error_id"], 50).select("error_id", "error_type")


@query(f"WITH {REF} SELECT record_id, CAST(ntile(6) OVER (ORDER BY coalesce(theorem_name, ''), coalesce(try_cast(trim(step_index) AS DOUBLE), -1), coalesce(error_tactic, ''), record_id) - 1 AS INTEGER) AS batch FROM ref")
def batch_slices(spark, d):
    """Six contiguous slices in the order (theorem, step number, wrong tactic)."""
    r = records(spark, d, "reflection_records", "theorem_name", "step_index", "error_tactic")
    number = F.coalesce(F.expr("try_cast(trim(step_index) AS DOUBLE)"), F.lit(-1.0))
    r = r.select("record_id", X.text(F.col("theorem_name")).alias("t"), number.alias("s"), X.text(F.col("error_tactic")).alias("e"))
    return W.slices(r, ["t", "s", "e", "record_id"], 6).select("record_id", "batch")


@query(f"WITH {ERR} SELECT error_id, CAST({hash_number_sql('theorem_full_name')} % 7 AS INTEGER) AS worker FROM err WHERE theorem_full_name IS NOT NULL")
def shard_by_theorem(spark, d):
    r = records(spark, d, "error_records", "theorem_full_name").where("theorem_full_name is not null")
    return W.round_robin(r, "theorem_full_name", 7).select("error_id", "worker")


@query(
    """WITH k AS (SELECT DISTINCT c_custkey FROM customer), r AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('42|' || c_custkey), c_custkey) - 1 AS i, count(*) OVER () AS n FROM k)
SELECT c_custkey, CASE WHEN i < floor(n * 0.9) THEN 'train' WHEN i < floor(n * 0.95) THEN 'val' ELSE 'test' END AS split FROM r"""
)
def ratio_split_keys(spark, d):
    return W.ratio_split(table(spark, d, "customer"), "c_custkey", {"train": 0.9, "val": 0.05, "test": 0.05})


@query(
    f"""WITH {ERR}, k AS (SELECT DISTINCT theorem_full_name FROM err WHERE theorem_full_name IS NOT NULL), r AS (SELECT theorem_full_name, row_number() OVER (ORDER BY md5('7|' || theorem_full_name), theorem_full_name) - 1 AS i, count(*) OVER () AS n FROM k),
s AS (SELECT theorem_full_name, CASE WHEN i < floor(n * 0.8) THEN 'train' WHEN i < floor(n * 0.9) THEN 'val' ELSE 'test' END AS part FROM r) SELECT error_id, part FROM err JOIN s USING (theorem_full_name)"""
)
def split_by_theorem(spark, d):
    """Rows follow their theorem's part, so no theorem is divided."""
    r = records(spark, d, "error_records", "theorem_full_name")
    parts = W.ratio_split(r, "theorem_full_name", {"train": 0.8, "val": 0.1, "test": 0.1}, seed=7).withColumnRenamed("split", "part")
    return r.join(parts, "theorem_full_name").select("error_id", "part")


@query(
    f"""WITH {COS}, a AS (SELECT cos_id, list_transform(full_cos_chain, lambda s: {FIRST.format('s.tactic')}) AS h FROM cos)
SELECT cos_id, array_to_string(list_filter(h, lambda x, i: NOT (i > 2 AND x = coalesce(h[i - 1], '') AND x = coalesce(h[i - 2], ''))), ',') AS heads FROM a"""
)
def run_length_cap(spark, d):
    """At most two equal tactic heads in a row."""
    heads = F.transform("full_cos_chain", lambda s: X.first_token(s["tactic"]))
    return records(spark, d, "cos_records", "full_cos_chain").withColumn("h", heads).select("cos_id", F.array_join(X.run_capped(F.col("h")), ",").alias("heads"))
