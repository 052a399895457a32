"""Report aggregates over the proof tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tacticmill.functions import text as X
from tacticmill.operators import reports as R
from tacticmill.operators import windows as W
from tacticmill.plans.base import COS, ERR, FIRST, REF, STEPS, query, records, steps, table


@query("SELECT module_path AS key, count(*) AS n FROM corpus GROUP BY 1 ORDER BY n DESC, key LIMIT 20")
def top_modules(spark, d):
    return R.top_counts(table(spark, d, "corpus"), F.col("module_path"), 20)


@query(f"WITH {STEPS} SELECT {FIRST.format('tactic')} AS key, count(*) AS n FROM steps GROUP BY 1 ORDER BY n DESC, key LIMIT 30")
def top_tactics(spark, d):
    return R.top_counts(steps(spark, d), X.first_token(F.col("tactic")), 30)


@query(f"WITH {ERR} SELECT verification_status AS key, count(*) AS n FROM err GROUP BY 1 ORDER BY n DESC, key NULLS LAST LIMIT 20")
def top_statuses(spark, d):
    return R.top_counts(records(spark, d, "error_records", "verification_status"), F.col("verification_status"), 20)


@query(f"WITH {REF}, a AS (SELECT length(reflection) AS n FROM ref) SELECT count(n) AS n, round(avg(n), 6) AS mean, max(n) AS longest, min(n) AS shortest, round(stddev_samp(n), 6) AS deviation, median(n) AS median FROM a")
def length_statistics(spark, d):
    return R.length_stats(records(spark, d, "reflection_records", "reflection"), F.col("reflection"))


@query(f"WITH {STEPS} SELECT count(*) AS n, count(DISTINCT substr(md5(state_before), 1, 16)) AS states, count(DISTINCT theorem_full_name) AS theorems FROM steps")
def distinct_states(spark, d):
    return steps(spark, d).agg(F.count("*").alias("n"), F.countDistinct(F.substring(F.md5("state_before"), 1, 16)).alias("states"), F.countDistinct("theorem_full_name").alias("theorems"))


_CITED = {
    "tactic_cited": ("contains(reflection, original_tactic)", lambda: F.contains("reflection", "original_tactic")),
    "error_cited": ("contains(reflection, error_tactic)", lambda: F.contains("reflection", "error_tactic")),
    "hint_cited": ("contains(reflection, repair_hint)", lambda: F.contains("reflection", "repair_hint")),
    "goal_cited": ("contains(reflection, '⊢')", lambda: F.contains("reflection", F.lit("⊢"))),
    "reasoned": ("regexp_matches(lower(reflection), 'because|since|therefore|thus')", lambda: F.lower("reflection").rlike("because|since|therefore|thus")),
}
_CITED_SQL = ", ".join(f"round(avg(CASE WHEN {s} THEN 1 ELSE 0 END), 6) AS {n}" for n, (s, _) in _CITED.items())


@query(f"WITH {REF} SELECT count(*) AS n, {_CITED_SQL} FROM ref")
def citation_rates(spark, d):
    r = records(spark, d, "reflection_records", "reflection", "original_tactic", "error_tactic", "repair_hint")
    return R.rates(r, {n: f() for n, (_, f) in _CITED.items()})


@query(f"WITH {REF} SELECT error_type, count(*) AS n, {_CITED_SQL} FROM ref GROUP BY error_type")
def citation_rates_by_type(spark, d):
    r = records(spark, d, "reflection_records", "reflection", "original_tactic", "error_tactic", "repair_hint", "error_type")
    return R.rates(r, {n: f() for n, (_, f) in _CITED.items()}, ["error_type"])


_SOURCES = ["error_injection", "synthetic", "synthetic_variant", "synthetic_renamed"]


@query(f"WITH {ERR} SELECT error_type, {', '.join(f'count(*) FILTER (WHERE source = {s!r}) AS {s}' for s in _SOURCES)}, count(*) AS total FROM err GROUP BY 1")
def type_by_source(spark, d):
    return R.cross_tab(records(spark, d, "error_records", "error_type", "source"), "error_type", "source", _SOURCES)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_totals(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query(f"WITH {REF} SELECT count(*) AS n, count(*) - count(DISTINCT md5(reflection)) AS same_text, count(*) - count(DISTINCT substr(reflection, 1, 200)) AS same_prefix FROM ref WHERE reflection IS NOT NULL")
def duplicate_report(spark, d):
    return R.duplicates(records(spark, d, "reflection_records", "reflection"), "reflection")


@query(f"WITH {ERR} SELECT theorem_full_name, step_index, count(*) AS n FROM err GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_combinations(spark, d):
    r = records(spark, d, "error_records", "theorem_full_name", "step_index")
    return r.groupBy("theorem_full_name", "step_index").agg(F.count("*").alias("n")).where("n > 1")


@query(f"WITH {REF}, a AS (SELECT length(reflection) AS v, row_number() OVER (ORDER BY length(reflection)) - 1 AS i, count(*) OVER () AS n FROM ref WHERE reflection IS NOT NULL) SELECT max(v) FILTER (WHERE i = floor(n * 0.5)) AS p50, max(v) FILTER (WHERE i = floor(n * 0.95)) AS p95, max(v) FILTER (WHERE i = floor(n * 0.99)) AS p99 FROM a")
def index_quantiles(spark, d):
    """Quantiles by nearest index of the sorted lengths."""
    r = records(spark, d, "reflection_records", "reflection").select(F.length("reflection").alias("v"))
    return W.nearest_rank(r, "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query(f"WITH {REF} SELECT CASE WHEN length(reflection) < 0 THEN '<0' WHEN length(reflection) < 100 THEN '0-100' WHEN length(reflection) < 300 THEN '100-300' WHEN length(reflection) < 600 THEN '300-600' WHEN length(reflection) < 900 THEN '600-900' ELSE '>=900' END AS bin, count(*) AS n FROM ref WHERE reflection IS NOT NULL GROUP BY 1")
def length_histogram(spark, d):
    return R.histogram(records(spark, d, "reflection_records", "reflection"), F.length("reflection"), [0, 100, 300, 600, 900])


@query(f"WITH {COS}, h AS (SELECT len(full_cos_chain) AS v, count(*) AS c FROM cos GROUP BY 1), x AS (SELECT v FROM h, range(c) t(i)) SELECT (SELECT sum(c) FROM h) AS n, (SELECT round(sum(v * c) / sum(c), 6) FROM h) AS mean, min(v) AS lowest, max(v) AS highest, median(v) AS median FROM x")
def weighted_histogram(spark, d):
    h = records(spark, d, "cos_records", "full_cos_chain").groupBy(F.size("full_cos_chain").alias("v")).agg(F.count("*").alias("c"))
    return R.weighted_stats(h, "v", "c")


@query(f"WITH {STEPS} SELECT cos_id, count(*) AS n, md5(string_agg(tactic, '|' ORDER BY step_index)) AS tactics FROM steps GROUP BY cos_id")
def collected_tactics(spark, d):
    g = steps(spark, d).groupBy("cos_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("step_index", "tactic"))).alias("s"))
    return g.select("cos_id", "n", F.md5(F.array_join("s.tactic", "|")).alias("tactics"))


@query(f"WITH {STEPS}, c AS (SELECT step_index, {FIRST.format('tactic')} AS value, count(*) AS n FROM steps GROUP BY 1, 2), r AS (SELECT *, round(n / sum(n) OVER (PARTITION BY step_index), 6) AS share, row_number() OVER (PARTITION BY step_index ORDER BY n DESC, value) AS rank FROM c) SELECT * FROM r WHERE rank <= 5")
def top_tactics_by_step(spark, d):
    return R.top_by_group(steps(spark, d), "step_index", X.first_token(F.col("tactic")), 5)


@query(f"WITH {REF}, a AS (SELECT avg(CASE WHEN contains(reflection, original_tactic) THEN 1.0 ELSE 0 END) AS t, avg(CASE WHEN contains(reflection, '⊢') THEN 1.0 ELSE 0 END) AS g, count(DISTINCT md5(reflection)) / count(*) AS u FROM ref), s AS (SELECT round(100 * (0.5 * t + 0.2 * g + 0.3 * u), 4) AS score FROM a) SELECT score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM s")
def weighted_grade(spark, d):
    r = records(spark, d, "reflection_records", "reflection", "original_tactic")
    hit = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    a = r.agg(hit(F.contains("reflection", "original_tactic")).alias("t"), hit(F.contains("reflection", F.lit("⊢"))).alias("g"), (F.countDistinct(F.md5("reflection")) / F.count("*")).alias("u"))
    score = F.round(100 * (0.5 * F.col("t") + 0.2 * F.col("g") + 0.3 * F.col("u")), 4)
    return a.select(score.alias("score"), R.grade(score).alias("grade"))


@query(f"WITH {ERR} SELECT split_part(verification_status, '_at_step', 1) AS reason, count(*) AS n, round(avg(CASE WHEN verification_status = 'verified' THEN 1 ELSE 0 END), 6) AS success FROM err GROUP BY 1")
def success_by_reason(spark, d):
    r = records(spark, d, "error_records", "verification_status")
    return r.groupBy(F.substring_index("verification_status", "_at_step", 1).alias("reason")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("verification_status") == "verified").cast("int")), 6).alias("success"))


@query("WITH a AS (SELECT value AS v, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL), m AS (SELECT round(avg(value), 6) AS mean FROM events) SELECT mean, max(v) FILTER (WHERE i = floor(n * 0.5)) AS p50, max(v) FILTER (WHERE i = floor(n * 0.95)) AS p95, max(v) FILTER (WHERE i = floor(n * 0.99)) AS p99 FROM a, m GROUP BY mean")
def latency_percentiles(spark, d):
    e = table(spark, d, "events").select("value")
    mean = e.agg(F.round(F.avg("value"), 6).alias("mean"))
    return W.nearest_rank(e, "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).withColumn("_k", F.lit(1)).join(mean.withColumn("_k", F.lit(1)), "_k").drop("_k")


@query(f"WITH {REF}, g AS (SELECT error_id, count(*) AS n, count(DISTINCT thought) AS d FROM ref GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS groups, count(*) FILTER (WHERE d <= 1) AS constant, count(*) FILTER (WHERE d > 1) AS varying FROM g")
def group_consistency(spark, d):
    return R.constancy(records(spark, d, "reflection_records", "error_id", "thought"), "error_id", "thought")


_WORDS = {"tactic_typo": "typo|spell|identifier", "wrong_tactic": "wrong|needed in place|natural move", "argument_error": "argument|premise", "missing_step": "missing|insert"}


@query(f"WITH {REF} SELECT error_type, count(*) AS n, count(*) FILTER (WHERE regexp_matches(lower(reflection), CASE error_type {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in _WORDS.items())} ELSE 'zzzz' END)) AS covered FROM ref GROUP BY 1")
def keyword_coverage(spark, d):
    hit = F.lit(False)
    for kind, pattern in _WORDS.items():
        hit = hit | (F.col("error_type") == kind) & F.lower("reflection").rlike(pattern)
    return records(spark, d, "reflection_records", "error_type", "reflection").groupBy("error_type").agg(F.count("*").alias("n"), F.count_if(hit).alias("covered"))


@query(f"WITH {REF} SELECT reflection_source, count(*) AS n, count(DISTINCT reflection) AS texts, count(DISTINCT substr(reflection, 1, 80)) AS prefixes FROM ref GROUP BY 1")
def prefix_diversity(spark, d):
    r = records(spark, d, "reflection_records", "reflection_source", "reflection")
    return r.groupBy("reflection_source").agg(F.count("*").alias("n"), F.countDistinct("reflection").alias("texts"), F.countDistinct(F.substring("reflection", 1, 80)).alias("prefixes"))


@query(f"WITH {COS} SELECT count(*) AS chains, count(*) FILTER (WHERE metadata.has_leandojo_trace) AS traced, count(*) FILTER (WHERE len(list_filter(full_cos_chain, lambda s: starts_with(coalesce(s.state_before, ''), '[state_'))) > 0) AS with_placeholder FROM cos")
def chain_audit(spark, d):
    r = records(spark, d, "cos_records", "metadata", "full_cos_chain")
    return r.agg(
        F.count("*").alias("chains"), F.count_if(F.col("metadata.has_leandojo_trace")).alias("traced"), F.count_if(F.exists("full_cos_chain", lambda s: X.text(s["state_before"]).startswith("[state_"))).alias("with_placeholder")
    )


@query(f"WITH {ERR} SELECT 'error_records' AS tbl, count(*) AS delivered, (SELECT count(*) FROM err) AS kept, count(*) - (SELECT count(*) FROM err) AS repeated FROM error_records")
def run_counters(spark, d):
    t = table(spark, d, "error_records")
    return t.agg(F.lit("error_records").alias("tbl"), F.count("*").alias("delivered"), F.countDistinct("error_id").alias("kept"), (F.count("*") - F.countDistinct("error_id")).alias("repeated"))


@query(f"WITH {ERR} SELECT count(*) AS n, round(count(*) * CAST(0.002 AS DOUBLE), 6) AS cost, round(count(*) / CAST(500.0 AS DOUBLE), 6) AS minutes FROM err")
def cost_estimate(spark, d):
    return records(spark, d, "error_records", "error_type").agg(F.count("*").alias("n"), F.round(F.count("*") * 0.002, 6).alias("cost"), F.round(F.count("*") / 500.0, 6).alias("minutes"))


@query(f"WITH {ERR} SELECT error_type, error_id, error_tactic FROM err QUALIFY row_number() OVER (PARTITION BY error_type ORDER BY error_id) = 1")
def first_examples(spark, d):
    return W.keep_first(records(spark, d, "error_records", "error_type", "error_tactic"), ["error_type"], ["error_id"])
