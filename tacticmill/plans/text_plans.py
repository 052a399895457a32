"""Text functions over the proof tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tacticmill.functions import parsing as Y
from tacticmill.functions import text as X
from tacticmill.plans.base import COS, ERR, FIRST, REF, STEPS, STRIP, hash_number_sql, query, records, steps, table


@query(f"WITH {COS} SELECT cos_id, string_split(theorem_full_name, '.')[-1] AS short, array_to_string(list_slice(string_split(theorem_full_name, '.'), -2, -1), '.') AS mid FROM cos WHERE theorem_full_name IS NOT NULL")
def name_suffixes(spark, d):
    r = records(spark, d, "cos_records", "theorem_full_name").where("theorem_full_name is not null")
    return r.select("cos_id", X.last_segments(F.col("theorem_full_name"), 1).alias("short"), X.last_segments(F.col("theorem_full_name"), 2).alias("mid"))


_SQUEEZED = r"regexp_replace(state_before, '\s+', ' ', 'g')"


@query(f"WITH {ERR} SELECT error_id, sha256(state_before) AS sha, md5(state_before) AS md, substr(md5(state_before), 1, 16) AS md16, substr(sha256({STRIP.format(_SQUEEZED)}), 1, 16) AS norm16 FROM err WHERE state_before IS NOT NULL")
def text_hashes(spark, d):
    r = records(spark, d, "error_records", "state_before").where("state_before is not null")
    s = F.col("state_before")
    return r.select("error_id", F.sha2(s, 256).alias("sha"), F.md5(s).alias("md"), F.substring(F.md5(s), 1, 16).alias("md16"), X.normalised_hash(s).alias("norm16"))


@query(f"WITH {COS} SELECT cos_id, replace(regexp_replace(regexp_replace(file_path, '\\.[A-Za-z0-9]+$', ''), '^.*?/?([A-Z][A-Za-z0-9_]*(?:/[A-Za-z0-9_]+)*)$', '\\1'), '/', '.') AS module FROM cos WHERE file_path IS NOT NULL")
def module_from_path(spark, d):
    return records(spark, d, "cos_records", "file_path").where("file_path is not null").select("cos_id", X.module_of(F.col("file_path")).alias("module"))


@query("SELECT name, array_to_string(list_sort(list_distinct(regexp_extract_all(type_expr, '[A-Za-z_][\\pL\\pN_.]*'))), ' ') AS tokens FROM corpus")
def identifier_tokens(spark, d):
    return table(spark, d, "corpus").select("name", F.array_join(X.identifiers(F.col("type_expr")), " ").alias("tokens"))


_GOAL = f"""CASE WHEN coalesce(state_before, '') = '' THEN '(empty state)' WHEN contains(state_before, '⊢') THEN (CASE WHEN length(g) > 200 THEN substr(g, 1, 200) || '...' ELSE g END)
WHEN {STRIP.format('substr(state_before, 1, 150)')} = '' THEN '(empty state)' ELSE {STRIP.format('substr(state_before, 1, 150)')} END"""
_FROM_GOAL = "substr(state_before, strpos(state_before, '⊢'))"
_WITH_GOAL = f"g0 AS (SELECT *, {STRIP.format(_FROM_GOAL)} AS g FROM err)"


@query(f"WITH {ERR}, {_WITH_GOAL} SELECT error_id, {_GOAL} AS goal FROM g0")
def goal_summaries(spark, d):
    return records(spark, d, "error_records", "state_before").select("error_id", X.goal_summary(F.col("state_before")).alias("goal"))


_HYPS = f"""h AS (SELECT error_id, state_before, CASE WHEN contains(coalesce(state_before, ''), '⊢') THEN list_filter(list_transform(string_split(substr(state_before, 1, strpos(state_before, '⊢') - 1), chr(10)), lambda l: {STRIP.format('l')}),
lambda l: l <> '' AND NOT starts_with(l, 'case ') AND NOT starts_with(l, 'context') AND contains(l, ':')) ELSE [] END AS lines FROM err),
h2 AS (SELECT error_id, list_filter(list_transform(lines, lambda l: {{'n': {STRIP.format("substr(l, 1, strpos(l, ':') - 1)")}, 't': {STRIP.format("substr(l, strpos(l, ':') + 1)")}}}), lambda p: p.n <> '' AND length(p.n) < 30) AS ps FROM h),
h3 AS (SELECT error_id, list_transform(ps, lambda p: p.n || ' : ' || CASE WHEN length(p.t) > 60 THEN substr(p.t, 1, 60) || '...' ELSE p.t END) AS xs FROM h2)"""
_CLAUSE = "CASE WHEN len(xs) = 0 THEN '' ELSE ' (with hypotheses ' || array_to_string(xs[1:4], ', ') || CASE WHEN len(xs) > 4 THEN ', ... (' || (len(xs) - 4) || ' more)' ELSE '' END || ')' END"


@query(f"WITH {ERR}, {_HYPS} SELECT error_id, {_CLAUSE} AS clause FROM h3")
def hypotheses_clauses(spark, d):
    return records(spark, d, "error_records", "state_before").select("error_id", X.hypotheses_clause(F.col("state_before")).alias("clause"))


_MESSAGE = f"""m AS (SELECT error_id, {STRIP.format("coalesce(error_message, '')")} AS b FROM err), m2 AS (SELECT error_id, coalesce(list_filter(list_transform(string_split(b, chr(10)), lambda l: {STRIP.format('l')}), lambda l: length(l) > 5)[1], b) AS f FROM m),
m3 AS (SELECT error_id, regexp_replace(CASE WHEN length(f) > 120 THEN substr(f, 1, 117) || '...' ELSE f END, '^["'']+|["'']+$', '', 'g') AS s FROM m2)"""


@query(f"WITH {ERR}, {_MESSAGE} SELECT error_id, CASE WHEN s = '' THEN 'an elaboration error' ELSE s END AS summary FROM m3")
def message_summaries(spark, d):
    return records(spark, d, "error_records", "error_message").select("error_id", X.message_summary(F.col("error_message")).alias("summary"))


_NAMES = f"""WITH {STEPS}, a AS (SELECT cos_id, step_index, {STRIP.format("coalesce(tactic, '')")} AS t FROM steps),
b AS (SELECT *, list_filter(list_transform(flatten(list_transform(regexp_extract_all(t, '\\[([^\\]]+)\\]', 1), lambda g: string_split(g, ','))), lambda p: regexp_replace({STRIP.format('p')}, '^[←↔]\\s*', '')), lambda p: length(p) > 2) AS inside,
list_filter(list_transform(regexp_split_to_array(regexp_replace(t, '[\\[\\]]', ' ', 'g'), '\\s+'), lambda w: regexp_replace(w, '^[(),;]+|[(),;]+$', '', 'g')), lambda w: w <> '') AS words FROM a),
c AS (SELECT *, inside || list_filter(words, lambda w: length(w) > 2 AND contains(w, '.') AND NOT starts_with(w, '-')) AS own, list_filter(words, lambda w: length(w) > 2 AND NOT list_contains({X.TACTIC_WORDS}, lower(w)))[1:1] AS plain FROM b)
SELECT cos_id, step_index, array_to_string(CASE WHEN len(own) > 0 THEN own WHEN len(plain) > 0 THEN plain WHEN t <> '' THEN [t] ELSE [] END, ' ') AS names FROM c"""


@query(_NAMES)
def tactic_names(spark, d):
    """What each tactic names; tested on cases and inside the consistency query."""
    return steps(spark, d).select("cos_id", "step_index", F.array_join(X.tactic_identifiers(F.col("tactic")), " ").alias("names"))


_SUFFIX = {"tactic_typo": " [typo]", "wrong_tactic": " [choice]", "missing_step": " [step]", "argument_error": " [argument]"}


@query(f"""WITH {ERR}, a AS (SELECT error_id, thought, regexp_replace(thought, '\\s+$', '') AS t, CASE error_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _SUFFIX.items())} END AS s FROM err)
SELECT error_id, CASE WHEN coalesce(thought, '') = '' OR s IS NULL THEN thought ELSE t || CASE WHEN t <> '' AND substr(t, length(t), 1) NOT IN ('.', '!', '?', '。') THEN '.' ELSE '' END || s END AS thought FROM a""")
def thought_suffix(spark, d):
    """A note by kind of error behind the thought, which gets its full stop first. The notes are a parameter table."""
    r = records(spark, d, "error_records", "thought", "error_type")
    table_ = F.create_map(*[F.lit(v) for kv in _SUFFIX.items() for v in kv])
    note, t = F.try_element_at(table_, F.col("error_type")), F.regexp_replace("thought", r"\s+$", "")
    dotted = F.concat(t, F.when((t != "") & ~F.substring(t, -1, 1).isin(".", "!", "?", "。"), F.lit(".")).otherwise(F.lit("")), note)
    return r.select("error_id", F.when((X.text(F.col("thought")) == "") | note.isNull(), F.col("thought")).otherwise(dotted).alias("thought"))


_TEMPLATES = [(k, i, t) for k in ("tactic_typo", "wrong_tactic", "argument_error", "missing_step") for i, t in enumerate([f"{k}: {{error_tactic}} -> {{original_tactic}}", f"{k}: use {{original_tactic}}; {{repair_hint}}", f"{k} at {{theorem_name}}: {{repair_hint}}"])]
_VARIANT = hash_number_sql("coalesce(theorem_name, '') || coalesce(error_tactic, '') || coalesce(CAST(step_index AS VARCHAR), '')")


@query(
    f"""WITH {ERR}, t(error_type, variant, template) AS (VALUES {', '.join(f"('{k}', {i}, '{t}')" for k, i, t in _TEMPLATES)})
SELECT error_id, CAST(variant AS INTEGER) AS variant, replace(replace(replace(replace(template, '{{error_tactic}}', coalesce(error_tactic, '')), '{{original_tactic}}', coalesce(original_tactic, '')), '{{repair_hint}}', coalesce(repair_hint, '')), '{{theorem_name}}', coalesce(theorem_name, '')) AS text
FROM err JOIN t USING (error_type) WHERE t.variant = {_VARIANT} % 3"""
)
def template_render(spark, d):
    """A template by kind and hashed variant, filled by literal replacement. The templates are a parameter table of fixed size."""
    r = records(spark, d, "error_records", "theorem_name", "error_tactic", "original_tactic", "repair_hint", "step_index", "error_type")
    variant = (X.hash_number(F.col("theorem_name"), F.col("error_tactic"), F.col("step_index").cast("string")) % 3).cast("int")
    t = spark.createDataFrame(_TEMPLATES, "error_type string, variant int, template string")
    j = r.withColumn("variant", variant).join(F.broadcast(t), ["error_type", "variant"])
    return j.select("error_id", "variant", X.filled(F.col("template"), **{k: F.col(k) for k in ("error_tactic", "original_tactic", "repair_hint", "theorem_name")}).alias("text"))


@query(
    f"""WITH {ERR} SELECT error_id, md5('State: ' || CASE WHEN length(state_before) > 1500 THEN substr(state_before, 1, 1500) || chr(10) || '... (truncated)' ELSE coalesce(state_before, '') END || chr(10) || 'Tried: ' || coalesce(error_tactic, '') || chr(10) || 'Message: ' ||
CASE WHEN length(error_message) > 500 THEN substr(error_message, 1, 500) || '... (truncated)' ELSE coalesce(error_message, '') END || chr(10) || 'Hint: ' || CASE WHEN {STRIP.format("coalesce(repair_hint, '')")} = '' THEN 'use ' || coalesce(original_tactic, '') ELSE repair_hint END) AS prompt FROM err"""
)
def prompt_build(spark, d):
    r = records(spark, d, "error_records", "state_before", "error_tactic", "error_message", "repair_hint", "original_tactic")
    hint = F.when(X.blank(F.col("repair_hint")), F.concat(F.lit("use "), X.text(F.col("original_tactic")))).otherwise(F.col("repair_hint"))
    parts = [F.lit("State: "), X.text(X.truncated(F.col("state_before"), 1500, "\n... (truncated)")), F.lit("\nTried: "), X.text(F.col("error_tactic")), F.lit("\nMessage: "), X.text(X.truncated(F.col("error_message"), 500, "... (truncated)")), F.lit("\nHint: "), hint]
    return r.select("error_id", F.md5(F.concat(*parts)).alias("prompt"))


@query(
    f"""WITH {REF}, a AS (SELECT record_id, coalesce(reflection, '') AS r, {STRIP.format("coalesce(repair_hint, '')")} AS hint, coalesce(state_before, '') AS s FROM ref),
b AS (SELECT *, list_filter(regexp_split_to_array(hint, '\\s+'), lambda w: length(w) > 3) AS ws FROM a),
c AS (SELECT *, len(ws) > 0 AND len(list_filter(ws, lambda w: contains(lower(r), lower(w)))) / greatest(len(ws), 1) < 0.3 AS add_hint, contains(s, '⊢') AND NOT contains(r, '⊢') AS add_goal FROM b) SELECT record_id, add_hint, add_goal FROM c"""
)
def output_enrichment(spark, d):
    """Which answers lack their hint (under 30 % of its longer words) and which lack the goal."""
    r = records(spark, d, "reflection_records", "reflection", "repair_hint", "state_before")
    low = F.lower(X.text(F.col("reflection")))
    words = F.filter(F.split(X.strip(X.text(F.col("repair_hint"))), r"\s+"), lambda w: F.length(w) > 3)
    hit = F.size(F.filter(words, lambda w: low.contains(F.lower(w))))
    add_hint = (F.size(words) > 0) & (hit / F.greatest(F.size(words), F.lit(1)) < 0.3)
    return r.select("record_id", add_hint.alias("add_hint"), (X.text(F.col("state_before")).contains("⊢") & ~X.text(F.col("reflection")).contains("⊢")).alias("add_goal"))


@query()
def parsed_outputs(spark, d):
    """Thought and tactic parsed back from rendered answers."""
    r = records(spark, d, "error_records", "thought", "original_tactic")
    rendered = F.concat(F.lit("[Thought] "), X.text(F.col("thought")), F.lit("\n[Tactic] "), X.text(F.col("original_tactic")))
    return r.select("error_id", Y.parse_output_column(rendered).alias("o")).select("error_id", "o.thought", "o.tactic")


@query()
def tactic_block_counts(spark, d):
    s = steps(spark, d)
    return s.select("cos_id", "step_index", F.size(Y.tactic_blocks_column(F.col("tactic"))).alias("blocks"), F.size(Y.goals_column(F.col("state_before"))).alias("goals"), F.size(Y.split_arguments_column(F.col("tactic"))).alias("words"))


@query()
def theorem_sources(spark, d):
    """Declarations of the source documents: name, stated type, mode of proof and number of tactics."""
    docs = table(spark, d, "documents").where("source = 'lean_source'").select("doc_id", F.posexplode(Y.theorem_blocks_column(F.col("text"))).alias("n", "block"))
    body = F.regexp_extract("block", r"(?s):=\s*(.*)$", 1)
    return docs.select("doc_id", "n", F.regexp_extract("block", r"(?:theorem|lemma)\s+(\S+)", 1).alias("name"), F.md5(Y.type_expression_column(F.col("block"))).alias("type"), Y.proof_mode_column(body).alias("proof_mode"), F.size(Y.tactic_lines_column(body)).alias("tactics"))


@query("SELECT doc_id, CAST(i - 1 AS INTEGER) AS n, m[i] AS name FROM (SELECT doc_id, regexp_extract_all(text, 'theorem ([a-z_A-Z]+)', 1) AS m FROM documents WHERE source = 'lean_source') a, unnest(range(1, len(m) + 1)) t(i)")
def theorem_names(spark, d):
    """Theorem names of the source documents by pattern."""
    docs = table(spark, d, "documents").where("source = 'lean_source'").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("theorem ([a-z_A-Z]+)"), 1)).alias("n", "name"))
    return docs


@query(f"WITH {REF} SELECT record_id, array_to_string(list_filter(p, lambda s, i: i = 1 OR s <> p[i - 1]), '.') AS fixed FROM (SELECT record_id, string_split(theorem_full_name, '.') AS p FROM ref WHERE theorem_full_name IS NOT NULL)")
def double_prefix(spark, d):
    return records(spark, d, "reflection_records", "theorem_full_name").where("theorem_full_name is not null").select("record_id", X.without_repeats(F.col("theorem_full_name")).alias("fixed"))


@query(
    f"""WITH {ERR} SELECT error_id, array_to_string(list_filter(list_transform(list_filter(list_transform(string_split(CASE WHEN contains(coalesce(state_before, ''), '⊢') THEN substr(state_before, 1, strpos(state_before, '⊢') - 1) ELSE coalesce(state_before, '') END, chr(10)), lambda l: {STRIP.format('l')}), lambda l: contains(l, ' : ')),
lambda l: {STRIP.format("substr(l, 1, strpos(l, ' : ') - 1)")}), lambda n: n <> '' AND NOT contains(n, '✝') AND NOT regexp_matches(n, '^[0-9]')), '|') AS names FROM err"""
)
def intro_names(spark, d):
    return records(spark, d, "error_records", "state_before").select("error_id", F.array_join(X.intro_names(F.col("state_before")), "|").alias("names"))


@query(f"WITH {STEPS} SELECT regexp_matches(lower({STRIP.format('tactic')}), '^(intro|intros|(intro|intros|rintro) .*)$') AS intro_like, count(*) AS n FROM steps GROUP BY 1")
def intro_like(spark, d):
    return steps(spark, d).groupBy(X.intro_like(F.col("tactic")).alias("intro_like")).agg(F.count("*").alias("n"))


@query(f"WITH {ERR} SELECT error_id, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(error_message, ''), '\\?\\w+\\.\\d+'))), ' ') AS metavars FROM err")
def metavariables(spark, d):
    return records(spark, d, "error_records", "error_message").select("error_id", F.array_join(X.metavariables(F.col("error_message")), " ").alias("metavars"))


_CLASS = "CASE " + " ".join("WHEN regexp_matches(lower(coalesce(error_message, '')), '(?s)" + p.replace("'", "''") + f"') THEN '{c}'" for p, c in X.ERROR_CLASSES) + " ELSE 'OTHER' END"
_CONF = "CASE c " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in X.CONFIDENCE.items()) + " END"


@query(f"WITH {ERR}, a AS (SELECT error_id, {_CLASS} AS c, coalesce(step_index, 0) AS f FROM err) SELECT error_id, c AS category, CASE WHEN c IN ('ELABORATION_ERROR', 'METAVAR_UNRESOLVED', 'TIMEOUT') OR f >= 3 THEN 'ESR' ELSE 'ETR' END AS route, CAST({_CONF} AS DOUBLE) AS confidence FROM a")
def error_diagnosis(spark, d):
    """Class of the message, route of repair (failures: the step index stands in) and confidence."""
    r = records(spark, d, "error_records", "error_message", "step_index").withColumn("category", X.error_class(F.col("error_message")))
    return r.select("error_id", "category", X.repair_route(F.col("category"), F.coalesce("step_index", F.lit(0))).alias("route"), X.confidence(F.col("category")).alias("confidence"))


@query(f"WITH {REF} SELECT record_id, coalesce(theorem_full_name, '') || '|' || coalesce(error_tactic, '') || '|' || coalesce(step_index, '') || '|' || coalesce(error_type, '') AS key FROM ref")
def record_keys(spark, d):
    r = records(spark, d, "reflection_records", "theorem_full_name", "error_tactic", "step_index", "error_type")
    return r.select("record_id", F.concat_ws("|", *[X.text(F.col(c)) for c in ("theorem_full_name", "error_tactic", "step_index", "error_type")]).alias("key"))


@query(f"WITH {ERR} SELECT error_id, list_transform([{{'role': 'system', 'content': 'You prove theorems.'}}, {{'role': 'user', 'content': coalesce(state_before, '')}}, {{'role': 'assistant', 'content': '[Thought] ' || coalesce(thought, '') || chr(10) || '[Tactic] ' || coalesce(original_tactic, '')}}], lambda m: m.role || ':' || md5(m.content)).array_to_string(',') AS messages FROM err WHERE coalesce(state_before, '') <> '' AND coalesce(original_tactic, '') NOT IN ('', 'sorry')")
def chat_messages(spark, d):
    r = records(spark, d, "error_records", "state_before", "thought", "original_tactic").where((X.text(F.col("state_before")) != "") & ~X.text(F.col("original_tactic")).isin("", "sorry"))
    answer = F.concat(F.lit("[Thought] "), X.text(F.col("thought")), F.lit("\n[Tactic] "), X.text(F.col("original_tactic")))
    messages = F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in (("system", F.lit("You prove theorems.")), ("user", F.col("state_before")), ("assistant", answer))])
    return r.select("error_id", F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), F.md5(m["content"]))), ",").alias("messages"))


@query(f"WITH {REF}, a AS (SELECT record_id, reflection, substr(coalesce(error_message, ''), 1, 40) AS m FROM ref) SELECT record_id, coalesce(length(m) >= 20 AND contains(reflection, substr(m, 1, 20)), false) AS cited FROM a")
def message_citation(spark, d):
    r = records(spark, d, "reflection_records", "reflection", "error_message").withColumn("m", F.substring(X.text(F.col("error_message")), 1, 40))
    return r.select("record_id", F.coalesce((F.length("m") >= 20) & F.contains("reflection", F.substring("m", 1, 20)), F.lit(False)).alias("cited"))


@query(
    f"""WITH {REF}, a AS (SELECT record_id, reflection, coalesce(error_message, '') AS e, regexp_extract(coalesce(error_message, ''), 'data=''([^'']+)''', 1, 's') AS inside FROM ref), b AS (SELECT record_id, reflection, e, CASE WHEN inside <> '' THEN inside ELSE e END AS m FROM a)
SELECT record_id, coalesce(length(e) >= 20 AND length(m) >= 10 AND contains(reflection, substr(m, 1, 20)), false) AS cited FROM b"""
)
def unwrapped_citation(spark, d):
    """Citation of the message inside its wrapper, by its first twenty characters."""
    r = records(spark, d, "reflection_records", "reflection", "error_message").withColumn("m", X.unwrapped_message(F.col("error_message")))
    long = (F.length(X.text(F.col("error_message"))) >= 20) & (F.length("m") >= 10)
    return r.select("record_id", F.coalesce(long & F.contains("reflection", F.substring("m", 1, 20)), F.lit(False)).alias("cited"))


@query(
    f"""WITH {STEPS}, a AS (SELECT cos_id, step_index, {STRIP.format("coalesce(tactic, '')")} AS t FROM steps)
SELECT cos_id, step_index, coalesce(nullif(regexp_extract(t, '^([\\pL\\pN_]+)', 1), ''), t) AS name, {' OR '.join(f"contains(t, '{c}')" for c in X.COMBINATORS)} AS combinator FROM a"""
)
def tactic_forms(spark, d):
    """Each step's tactic: its name and whether it combines others."""
    return steps(spark, d).select("cos_id", "step_index", X.single_tactic(F.col("tactic")).alias("t")).select("cos_id", "step_index", "t.name", "t.combinator")


@query(r"SELECT doc_id, CAST(i - 1 AS INTEGER) AS n, m[i] AS module FROM (SELECT doc_id, regexp_extract_all(text, '(?m)^import[ \t]+([^ \t\n][^\n]*)', 1) AS m FROM documents WHERE source = 'lean_source') a, unnest(range(1, len(m) + 1)) t(i)")
def source_imports(spark, d):
    """Modules that the source documents import, in their order."""
    docs = table(spark, d, "documents").where("source = 'lean_source'")
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?m)^import[ \t]+([^ \t\n][^\n]*)"), 1)).alias("n", "module"))


@query()
def namespace_ranges(spark, d):
    """Namespaces of the source documents with their lines."""
    docs = table(spark, d, "documents").where("source = 'lean_source'")
    return docs.select("doc_id", F.explode(Y.namespaces_column(F.col("text"))).alias("r")).select("doc_id", "r.name", "r.start", "r.end")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_valid(props) AS ok FROM events")
def json_parse(spark, d):
    """Tolerant JSON parsing with a flag for what did not parse."""
    parsed = F.from_json("props", "k bigint, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return table(spark, d, "events").select("event_id", parsed.alias("p")).select("event_id", "p.k", F.col("p._corrupt_record").isNull().alias("ok"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM events")
def timestamps(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp"))
