"""Graph, search-tree, augmentation and sampling operators."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tacticmill.functions import text as X
from tacticmill.operators import augment as A
from tacticmill.operators import graph as G
from tacticmill.operators import joins as J
from tacticmill.operators import sampling as S
from tacticmill.plans.base import COS, ERR, FIRST, STEPS, STRIP, hash_number_sql, query, records, steps, table

_TREE = "tree AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent, round(p_retailprice, 2) AS reward, p_size % 10 = 0 AS solved FROM part)"
_PATHS = f"WITH RECURSIVE {_TREE}, up(node, ancestor, distance) AS (SELECT node, parent, 1 FROM tree WHERE parent IS NOT NULL UNION ALL SELECT u.node, t.parent, u.distance + 1 FROM up u JOIN tree t ON t.node = u.ancestor WHERE t.parent IS NOT NULL)"


def _tree(spark, d):
    """A tree by parent pointer over the parts: each node hangs under the half of its number."""
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2)).alias("parent"), F.round("p_retailprice", 2).alias("reward"), (F.col("p_size") % 10 == 0).alias("solved"))


@query("SELECT k AS node, min(k - k % 49) AS component FROM (SELECT c_custkey AS k FROM customer UNION SELECT c_custkey - c_custkey % 7 FROM customer UNION SELECT c_custkey - c_custkey % 49 FROM customer) GROUP BY k")
def components(spark, d):
    """Connected components of chained stars over the customer numbers."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    edges = c.select(F.col("k").alias("a"), (F.col("k") - F.col("k") % 7).alias("b")).union(c.select((F.col("k") - F.col("k") % 7).alias("a"), (F.col("k") - F.col("k") % 49).alias("b")))
    return G.connected_components(edges)


@query(_PATHS + " SELECT node, string_agg(CAST(ancestor AS VARCHAR), '>' ORDER BY distance DESC) || '>' || node AS path FROM up GROUP BY node")
def root_paths(spark, d):
    return G.root_path(G.ancestors(_tree(spark, d), "node", "parent"), "node")


@query(_PATHS + " SELECT node, ancestor, distance FROM up WHERE distance <= 3")
def nearest_ancestors(spark, d):
    return G.nearest(_tree(spark, d), "node", "parent", 3)


@query(_PATHS + " SELECT k AS node, count(*) AS visits, round(sum(reward), 6) AS value FROM (SELECT node AS k, reward FROM tree UNION ALL SELECT ancestor, t.reward FROM up JOIN tree t USING (node)) GROUP BY k")
def backpropagation(spark, d):
    return G.backpropagated(_tree(spark, d), "node", "parent", "reward")


@query(_PATHS + ", p AS (SELECT u.node, string_agg(lpad(CAST(ancestor AS VARCHAR), 12, '0'), '>' ORDER BY distance DESC) || '>' || lpad(CAST(u.node AS VARCHAR), 12, '0') AS path FROM up u GROUP BY 1) SELECT arg_min(node, path) AS node, min(path) AS path FROM p JOIN tree USING (node) WHERE solved")
def first_solved(spark, d):
    """First solved node in pre-order: the least padded path."""
    t = _tree(spark, d)
    closure = G.ancestors(t, "node", "parent").withColumn("ancestor", F.lpad(F.col("ancestor").cast("string"), 12, "0"))
    g = closure.groupBy("node").agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("o"), "ancestor"))).alias("p"))
    paths = g.select("node", F.concat_ws(">", F.array_join("p.ancestor", ">"), F.lpad(F.col("node").cast("string"), 12, "0")).alias("path"))
    return paths.join(t.where("solved").select("node"), "node").agg(F.min_by("node", "path").alias("node"), F.min("path").alias("path"))


@query("WITH a AS (SELECT o_custkey AS parent, o_orderkey AS node, o_totalprice / 100000 AS value, 1 + o_orderkey % 5 AS visits FROM orders), b AS (SELECT *, sum(visits) OVER (PARTITION BY parent) AS pv FROM a), c AS (SELECT *, round(value / visits + 1.414 * sqrt(ln(greatest(pv, 1)) / visits), 9) AS score FROM b) SELECT parent, node, round(score, 6) AS score FROM c QUALIFY row_number() OVER (PARTITION BY parent ORDER BY c.score DESC, node) = 1")
def best_child(spark, d):
    """The child with the greatest upper confidence bound of each parent."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("node"), (F.col("o_totalprice") / 100000).alias("value"), (1 + F.col("o_orderkey") % 5).alias("visits"))
    totals = o.groupBy("parent").agg(F.sum("visits").alias("pv"))
    scored = o.join(totals, "parent").withColumn("score", F.round(G.ucb(F.col("value"), F.col("visits"), F.col("pv")), 9))
    g = scored.groupBy("parent").agg(F.min(F.struct((-F.col("score")).alias("less"), "node")).alias("best"))
    return g.select("parent", F.col("best.node").alias("node"), F.round(-F.col("best.less"), 6).alias("score"))


@query(f"WITH {STEPS}, a AS (SELECT cos_id, step_index, md5(state_before) AS digest, tactic FROM steps WHERE state_before IS NOT NULL) SELECT digest, arg_min(cos_id, cos_id * 1000 + step_index) AS cos_id, arg_min(step_index, cos_id * 1000 + step_index) AS step_index, count(*) AS visit_count FROM a GROUP BY digest")
def state_registry(spark, d):
    s = steps(spark, d).where("state_before is not null").withColumn("digest", F.md5("state_before"))
    return G.registry(s, "digest", ["cos_id", "step_index"], ["cos_id", "step_index"])


@query(f"WITH {STEPS} SELECT count(*) AS states, count(*) FILTER (WHERE contains(state_before, '⊢')) AS open_states, count(*) FILTER (WHERE step_index = 0) AS roots, count(DISTINCT cos_id) AS chains FROM steps")
def registry_stats(spark, d):
    return steps(spark, d).agg(F.count("*").alias("states"), F.count_if(F.contains("state_before", F.lit("⊢"))).alias("open_states"), F.count_if(F.col("step_index") == 0).alias("roots"), F.countDistinct("cos_id").alias("chains"))


_META = f"{ERR}, m AS (SELECT DISTINCT error_id, unnest(regexp_extract_all(coalesce(error_message, ''), '\\?\\w+\\.\\d+')) AS v FROM err)"


@query(f"WITH {_META} SELECT error_id, v, min(error_id) OVER (PARTITION BY v) AS leader, count(*) OVER (PARTITION BY v) - 1 AS n_links FROM m WHERE ('0x' || substr(md5(v), 1, 1))::INTEGER < 12 QUALIFY n_links > 0")
def coupled_by_metavariable(spark, d):
    """Records that share an unbound metavariable, as classes; a hashed quarter of the variables counts as bound."""
    m = records(spark, d, "error_records", "error_message").select("error_id", F.explode(X.metavariables(F.col("error_message"))).alias("v"))
    return J.coupling(m, "error_id", "v", F.conv(F.substring(F.md5("v"), 1, 1), 16, 10).cast("int") < 12)


@query(f"WITH {_META}, b AS (SELECT v, min(error_id) AS binder FROM m GROUP BY v HAVING count(*) > 1) SELECT v, binder, count(*) AS dependents FROM m JOIN b USING (v) GROUP BY 1, 2")
def metavariable_bindings(spark, d):
    """A binding reaches every record that mentions the variable."""
    m = records(spark, d, "error_records", "error_message").select("error_id", F.explode(X.metavariables(F.col("error_message"))).alias("v"))
    b = m.groupBy("v").agg(F.min("error_id").alias("binder"), F.count("*").alias("dependents")).where("dependents > 1")
    return b.select("v", "binder", "dependents")


@query(
    f"""WITH {STEPS}, a AS (SELECT cos_id, step_index, len(regexp_extract_all(coalesce(state_before, ''), '⊢')) AS b, len(regexp_extract_all(coalesce(state_after, ''), '⊢')) AS c, lower(trim(coalesce(state_after, ''))) AS t FROM steps)
SELECT cos_id, round(sum(CASE WHEN t IN ('no goals', 'goals accomplished') OR c = 0 THEN 1.0 WHEN c < b THEN 0.3 WHEN c = b THEN 0.05 ELSE -0.1 END), 6)::DOUBLE AS reward FROM a GROUP BY cos_id"""
)
def chain_rewards(spark, d):
    s = steps(spark, d)
    return s.groupBy("cos_id").agg(F.round(F.sum(G.goal_delta(X.text(F.col("state_before")), X.text(F.col("state_after")))), 6).alias("reward"))


# ---- augmentation


def _errors_sql() -> str:
    head, own = FIRST.format("tactic"), "cos_id || '|' || step_index || '|' || error_type"
    n, h = f"length({head})", hash_number_sql(own)
    at = f"({h} % greatest({n} - 1, 1) + 1)"
    inner = f"({h} % greatest({n} - 2, 1) + 2)"
    typo = f"""CASE WHEN (CASE WHEN {n} >= 4 THEN {h} % 3 ELSE {h} % 2 END) = 0 THEN substr({head}, 1, CAST({at} - 1 AS BIGINT)) || substr({head}, CAST({at} + 1 AS BIGINT), 1) || substr({head}, CAST({at} AS BIGINT), 1) || substr({head}, CAST({at} + 2 AS BIGINT))
WHEN (CASE WHEN {n} >= 4 THEN {h} % 3 ELSE {h} % 2 END) = 1 THEN substr({head}, 1, CAST({at} AS BIGINT)) || substr({head}, CAST({at} AS BIGINT)) ELSE substr({head}, 1, CAST({inner} - 1 AS BIGINT)) || substr({head}, CAST({inner} + 1 AS BIGINT)) END"""
    pool = f"list_filter({A.POOL}, lambda p: p <> {head})"
    rest = r"regexp_extract(tactic, '(?s)^\s*\S+\s*(.*)$', 1)"
    wrong = f"{pool}[CAST({h} % len({pool}) AS BIGINT) + 1] || CASE WHEN {rest} <> '' THEN ' ' || {rest} ELSE '' END"
    missing = f"{A.STAND_INS}[CAST({h} % 3 AS BIGINT) + 1]"
    draw = hash_number_sql("cos_id || '|' || step_index")
    return f"""WITH {STEPS}, k AS (SELECT cos_id, step_index, tactic, unnest(CASE WHEN step_index = 0 THEN {A.ERROR_TYPES} ELSE [CASE WHEN {draw} / 4294967296.0 < 0.25 THEN 'tactic_typo' WHEN {draw} / 4294967296.0 < 0.5 THEN 'wrong_tactic' WHEN {draw} / 4294967296.0 < 0.75 THEN 'argument_error' ELSE 'missing_step' END] END) AS error_type
FROM steps WHERE coalesce(tactic, '') <> ''), m AS (SELECT cos_id, step_index, tactic, error_type, CASE error_type WHEN 'tactic_typo' THEN CASE WHEN {n} >= 3 AND ({typo}) <> {head} THEN ({typo}) || substr(tactic, strpos(tactic, {head}) + {n}) END WHEN 'wrong_tactic' THEN {wrong} ELSE {missing} END AS error_tactic FROM k WHERE error_type <> 'argument_error')
SELECT cos_id, step_index, error_type, error_tactic FROM m WHERE coalesce(error_tactic, '') <> '' AND error_tactic <> tactic"""


@query(_errors_sql())
def error_injection(spark, d):
    """Typos, wrong heads and missing steps: all kinds at step 0, one drawn kind later."""
    return A.inject(steps(spark, d), ["cos_id", "step_index"], "tactic", "step_index").where("error_type <> 'argument_error'").select("cos_id", "step_index", "error_type", "error_tactic")


def _hints_sql() -> str:
    head, bad = FIRST.format("tactic"), FIRST.format("error_tactic")
    h = hash_number_sql("cos_id || '|' || step_index || '|' || error_type")
    mapped = " ".join(f"WHEN error_type = 'tactic_typo' AND {head} = '{name}' THEN {forms}[CAST({h} % {len(forms)} AS BIGINT) + 1] || substr(tactic, strpos(tactic, '{name}') + {len(name)})" for name, forms in A.TYPOS.items())
    made = _errors_sql().replace("CASE error_type WHEN 'tactic_typo' THEN", f"CASE {mapped} WHEN error_type = 'tactic_typo' THEN", 1).replace("WHEN 'wrong_tactic' THEN", "WHEN error_type = 'wrong_tactic' THEN", 1)
    made = made.replace("SELECT cos_id, step_index, error_type, error_tactic FROM m", ", e AS (SELECT * FROM m", 1)
    return f"""{made}) SELECT cos_id, step_index, error_type, error_tactic, CASE error_type WHEN 'tactic_typo' THEN 'typo: ''' || {bad} || ''' should be ''' || {head} || '''' WHEN 'wrong_tactic' THEN 'wrong tactic: should use ''' || {head} || ''' instead of ''' || {bad} || ''''
ELSE 'missing step: used ''' || error_tactic || ''' placeholder, should be ''' || tactic || '''' END AS repair_hint FROM e"""


@query(_hints_sql())
def error_hints(spark, d):
    """Injected errors with usual misspellings and the hint that leads back."""
    e = A.inject_with_hints(steps(spark, d), ["cos_id", "step_index"], "tactic", "step_index").where("error_type <> 'argument_error'")
    return e.select("cos_id", "step_index", "error_type", "error_tactic", "repair_hint")


def _argument_sql() -> str:
    head = FIRST.format("tactic")
    h = hash_number_sql("cos_id || '|' || step_index || '|' || error_type")
    drawn = _errors_sql().replace("WHERE error_type <> 'argument_error'", "WHERE error_type = 'tactic_typo' OR error_type = 'argument_error'")
    drawn = drawn[: drawn.index(", m AS (")]
    typo = re.search(r"WHEN 'tactic_typo' THEN (CASE WHEN .*? END) WHEN 'wrong_tactic'", _errors_sql(), re.S).group(1)
    return f"""{drawn}, a AS (SELECT cos_id, step_index, error_type, tactic, {h} AS h, regexp_split_to_array({STRIP.format('tactic')}, '\\s+') AS ws FROM k WHERE error_type = 'argument_error'),
b AS (SELECT *, len(ws) - 1 AS n, ws[2:] AS args, CAST(h % greatest(len(ws) - 1, 1) AS BIGINT) AS i FROM a), c AS (SELECT *, (i + 1) % greatest(n, 1) AS j FROM b),
e AS (SELECT cos_id, step_index, tactic, CASE WHEN n < 1 THEN {typo} WHEN h % 3 = 2 THEN array_to_string([ws[1]] || args[1:i] || ['h'] || args[i + 1:], ' ') WHEN n < 2 THEN NULL
WHEN h % 3 = 0 THEN array_to_string([ws[1]] || list_transform(args, lambda x, p: CASE WHEN p - 1 = i THEN args[j + 1] WHEN p - 1 = j THEN args[i + 1] ELSE x END), ' ') ELSE array_to_string([ws[1]] || list_filter(args, lambda x, p: p - 1 <> i), ' ') END AS error_tactic FROM c)
SELECT cos_id, step_index, tactic, error_tactic FROM e WHERE coalesce(error_tactic, '') <> '' AND error_tactic <> tactic"""


@query(_argument_sql())
def argument_errors(spark, d):
    """Swapped, dropped and inserted arguments; properties are tested."""
    return A.inject(steps(spark, d), ["cos_id", "step_index"], "tactic", "step_index").where("error_type = 'argument_error'").select("cos_id", "step_index", "tactic", "error_tactic")


_STATEMENTS = [("algebra", 0, "x + {n} = {n} + x", "ring"), ("algebra", 1, "x * {n} = {n} * x", "ring"), ("order", 0, "x < x + {n} + 1", "omega"), ("logic", 0, "x = {n} -> x = {n}", "intro h")]
_COUNTS = A.quotas(101, {"algebra": 0.5, "order": 0.3, "logic": 0.2})


@query(
    f"""WITH t(category, template_id, statement) AS (VALUES {', '.join(f"('{c}', {i}, '{s}')" for c, i, s, _ in _STATEMENTS)}), w(category, wanted) AS (VALUES {', '.join(f"('{c}', {n})" for c, n in _COUNTS.items())}),
p AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY template_id) - 1 AS slot, count(*) OVER (PARTITION BY category) AS per FROM t), r AS (SELECT category, template_id, statement, per, i FROM p JOIN w USING (category), range(1000) x(i) WHERE i < wanted AND i % per = slot)
SELECT category, CAST(template_id AS INTEGER) AS template_id, CAST(i AS INTEGER) AS i, CASE WHEN i % 2 = 1 THEN regexp_replace(replace(statement, '{{n}}', CAST(i AS VARCHAR)), '\\bx\\b', ['a', 'b', 'c'][i % 3 + 1], 'g') ELSE replace(statement, '{{n}}', CAST(i AS VARCHAR)) END AS theorem_statement,
CASE WHEN i % 2 = 1 THEN 'synthetic_renamed' WHEN i >= per THEN 'synthetic_variant' ELSE 'synthetic' END AS source FROM r"""
)
def synthetic_statements(spark, d):
    """Quotas by category, templates cycled, variants and renamings; sizes are parameters of the generator."""
    return A.synthesise(spark.createDataFrame(_STATEMENTS, "category string, template_id int, statement string, proof string"), _COUNTS, ["a", "b", "c"])


# ---- order, samples, mixes


@query(f"WITH {ERR} SELECT error_id FROM err ORDER BY md5('42|' || error_id), error_id LIMIT 100")
def seeded_sample(spark, d):
    """100 records without replacement: the operator is the sample."""
    return S.sample(records(spark, d, "error_records", "error_type"), "error_id", 100).select("error_id")


@query(f"WITH {ERR}, n AS (SELECT error_id FROM err WHERE source = 'synthetic'), b AS (SELECT error_id FROM err WHERE source = 'error_injection'), w AS (SELECT CAST(floor((SELECT count(*) FROM n) * 0.3 / (1 - 0.3)) AS BIGINT) AS k), s AS (SELECT error_id FROM b QUALIFY row_number() OVER (ORDER BY md5('42|' || error_id), error_id) <= (SELECT k FROM w)) SELECT error_id, 'new' AS origin FROM n UNION ALL SELECT error_id, 'base' FROM s")
def ratio_mix(spark, d):
    """New records with 30 % of old ones mixed in."""
    e = records(spark, d, "error_records", "source")
    return S.mix(e.where("source = 'synthetic'").select("error_id"), e.where("source = 'error_injection'").select("error_id"), "error_id", 0.3)


@query(f"WITH {ERR}, a AS (SELECT error_id, {hash_number_sql('CAST(error_id AS VARCHAR)')} / 4294967296.0 AS u FROM err) SELECT CASE WHEN u < 0.5 THEN 'a' WHEN u < 0.8 THEN 'b' ELSE 'c' END AS kind, count(*) AS n FROM a GROUP BY 1")
def weighted_categories(spark, d):
    kind = A.weighted_draw(F.col("error_id").cast("string"), {"a": 0.5, "b": 0.3, "c": 0.2})
    return records(spark, d, "error_records", "error_type").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer ORDER BY c_mktsegment = 'BUILDING', floor(c_acctbal), c_custkey LIMIT (SELECT greatest(count(*) - 1000, 0) FROM customer)")
def eviction(spark, d):
    """What a registry of 1000 entries drops: unsolved first, then least visited."""
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_mktsegment") == "BUILDING").alias("solved"), F.floor("c_acctbal").alias("visits"))
    return S.evicted(c, "solved", "visits", "c_custkey", 1000).select("c_custkey")


@query("SELECT o_custkey, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def argmax_by_group(spark, d):
    return S.best(table(spark, d, "orders"), "o_custkey", F.col("o_totalprice"), "o_orderkey")


@query("WITH w AS (SELECT event_type, sum(value) AS v FROM events GROUP BY 1) SELECT event_type, round(v / sum(v) OVER (), 6) AS weight FROM w")
def normalised_weights(spark, d):
    from pyspark.sql import Window

    w = table(spark, d, "events").groupBy("event_type").agg(F.sum("value").alias("v"))
    return w.select("event_type", F.round(F.col("v") / F.sum("v").over(Window.partitionBy()), 6).alias("weight"))
