"""Making faulty tactics and synthetic statements, seeded by hash so reruns agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tacticmill.functions.text import first_token, hash_number, hash_unit, strip, text

# Kinds of injected errors, the replacement pool and stand-ins for a missing step.
ERROR_TYPES = ["tactic_typo", "wrong_tactic", "argument_error", "missing_step"]
POOL = ["simp", "ring", "norm_num", "omega", "trivial", "assumption"]
STAND_INS = ["done", "rfl", "exact _"]
# Usual misspellings of frequent tactics.
TYPOS = {"simp": ["simpp", "smp", "sinp"], "apply": ["aply", "appply", "aplly"], "exact": ["excat", "exaxt", "ecact"], "rw": ["wr", "rww", "re"], "intro": ["intto", "inro", "introo"]}


def weighted_draw(key: Column, weights: dict[str, float]) -> Column:
    """A category by cumulative weight of the hashed key."""
    total, bound, u = sum(weights.values()), 0.0, hash_unit(key)
    names = list(weights)
    out = None
    for name in names[:-1]:
        bound += weights[name] / total
        out = F.when(u < bound, name) if out is None else out.when(u < bound, name)
    return out.otherwise(names[-1]) if out is not None else F.lit(names[-1])


def rest_of(tactic: Column) -> Column:
    return F.regexp_extract(tactic, r"(?s)^\s*\S+\s*(.*)$", 1)


def typo(tactic: Column, head: Column, h: Column) -> Column:
    """The head with two letters swapped, one doubled or, from four letters on, one dropped; NULL if that changes nothing. h: a hash."""
    n = F.length(head)
    at = (h % F.greatest(n - 1, F.lit(1)) + 1).cast("int")
    cutting = F.when(n >= 4, h % 3).otherwise(h % 2)
    swapped = F.concat(F.substring(head, F.lit(1), at - 1), F.substring(head, at + 1, F.lit(1)), F.substring(head, at, F.lit(1)), F.substring(head, at + 2, n))
    doubled = F.concat(F.substring(head, F.lit(1), at), F.substring(head, at, n))
    inner = (h % F.greatest(n - 2, F.lit(1)) + 2).cast("int")
    dropped = F.concat(F.substring(head, F.lit(1), inner - 1), F.substring(head, inner + 1, n))
    made = F.when(cutting == 0, swapped).when(cutting == 1, doubled).otherwise(dropped)
    return F.when((n >= 3) & (made != head), F.concat(made, F.substring(tactic, F.position(head, tactic) + n, F.length(tactic))))


def wrong_tactic(tactic: Column, head: Column, h: Column) -> Column:
    """Another head from the pool, the arguments kept."""
    others = F.array_remove(F.array(*map(F.lit, POOL)), head)
    chosen = F.get(others, (h % F.size(others)).cast("int"))
    rest = rest_of(tactic)
    return F.when(rest != "", F.concat(chosen, F.lit(" "), rest)).otherwise(chosen)


def argument_error(tactic: Column, head: Column, h: Column) -> Column:
    """Two arguments swapped, one dropped or one inserted; without arguments a typo."""
    words = F.split(strip(tactic), r"\s+")
    args = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    n = F.size(words) - 1
    kind = h % 3
    i = (h % F.greatest(n, F.lit(1))).cast("int")
    j = F.pmod(i + 1, F.greatest(n, F.lit(1)))
    swapped = F.transform(args, lambda a, k: F.when(k == i, F.get(args, j)).when(k == j, F.get(args, i)).otherwise(a))
    dropped = F.filter(args, lambda a, k: k != i)
    inserted = F.concat(F.slice(args, F.lit(1), i), F.array(F.lit("h")), F.slice(args, i + 1, F.greatest(n - i, F.lit(0))))
    made = F.when((kind == 0) & (n >= 2), swapped).when((kind == 1) & (n >= 2), dropped).when(kind == 2, inserted)
    joined = F.when(made.isNotNull(), F.array_join(F.concat(F.slice(words, 1, 1), made), " "))
    return F.when(n < 1, typo(tactic, head, h)).otherwise(joined)


def missing_step(h: Column) -> Column:
    return F.get(F.array(*map(F.lit, STAND_INS)), (h % len(STAND_INS)).cast("int"))


def correction_pair(tactic: Column, head: Column, h: Column) -> Column:
    """A faulty form of a tactic: a typo, or where none is possible another head."""
    return F.coalesce(typo(tactic, head, h), wrong_tactic(tactic, head, h))


def inject(steps: DataFrame, key: list[str], tactic: str, step: str, weights: dict[str, float] | None = None, misspelt: Callable[[Column, Column, Column], Column] = typo) -> DataFrame:
    """(key, error_type, error_tactic): all types at the first step, one weighted type at the others; unchanged tactics drop out."""
    weights = weights or dict.fromkeys(ERROR_TYPES, 1.0)
    seed = F.concat_ws("|", *key)
    kinds = F.when(F.col(step) == 0, F.array(*map(F.lit, ERROR_TYPES))).otherwise(F.array(weighted_draw(seed, weights)))
    rows = steps.where(text(F.col(tactic)) != "").select(*key, tactic, first_token(F.col(tactic)).alias("_head"), F.explode(kinds).alias("error_type"))
    rows = rows.withColumn("_h", hash_number(F.concat_ws("|", *key, "error_type")))
    t, head, h, kind = F.col(tactic), F.col("_head"), F.col("_h"), F.col("error_type")
    made = F.when(kind == "tactic_typo", misspelt(t, head, h)).when(kind == "wrong_tactic", wrong_tactic(t, head, h)).when(kind == "argument_error", argument_error(t, head, h)).otherwise(missing_step(h))
    # generated, so that the conditions below do not copy the expression
    faulty = rows.select("*", F.explode(F.array(made)).alias("error_tactic")).drop("_head", "_h")
    return faulty.where("error_tactic is not null and error_tactic <> ''").where(F.col("error_tactic") != t)


def mapped_typo(tactic: Column, head: Column, h: Column, typos: dict[str, list[str]]) -> Column:
    """A usual misspelling of the head where one is listed, else a made one."""
    out = typo(tactic, head, h)
    for name, forms in typos.items():
        chosen = F.get(F.array(*map(F.lit, forms)), (h % len(forms)).cast("int"))
        out = F.when(head == name, F.concat(chosen, F.substring(tactic, F.position(head, tactic) + F.length(head), F.length(tactic)))).otherwise(out)
    return out


def argument_hint(tactic: Column, h: Column) -> Column:
    """What ``argument_error`` did to the arguments."""
    words = F.split(strip(tactic), r"\s+")
    n = F.size(words) - 1
    i = (h % F.greatest(n, F.lit(1))).cast("int")
    j = F.pmod(i + 1, F.greatest(n, F.lit(1)))
    place = (i + 1).cast("string")
    swapped = F.concat(F.lit("swapped args: positions "), place, F.lit(" and "), (j + 1).cast("string"))
    dropped = F.concat(F.lit("missing arg: arg "), place, F.lit(" '"), F.get(words, i + 1), F.lit("' was removed"))
    inserted = F.concat(F.lit("extra arg: inserted 'h' at position "), place)
    return F.when(h % 3 == 0, swapped).when(h % 3 == 1, dropped).otherwise(inserted)


def inject_with_hints(steps: DataFrame, key: list[str], tactic: str, step: str, weights: dict[str, float] | None = None, typos: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, error_type, error_tactic, repair_hint) like ``inject``, typos taken from ``typos`` where it lists the head."""
    typos = TYPOS if typos is None else typos
    made = inject(steps, key, tactic, step, weights, lambda t, head, h: mapped_typo(t, head, h, typos))
    t, bad = F.col(tactic), F.col("error_tactic")
    h = hash_number(F.concat_ws("|", *key, "error_type"))
    head, wrong = first_token(t), first_token(bad)
    slip = F.concat(F.lit("typo: '"), wrong, F.lit("' should be '"), head, F.lit("'"))
    hint = (
        F.when(F.col("error_type") == "tactic_typo", slip)
        .when(F.col("error_type") == "wrong_tactic", F.concat(F.lit("wrong tactic: should use '"), head, F.lit("' instead of '"), wrong, F.lit("'")))
        .when(F.col("error_type") == "missing_step", F.concat(F.lit("missing step: used '"), bad, F.lit("' placeholder, should be '"), t, F.lit("'")))
        .when(F.size(F.split(strip(t), r"\s+")) < 2, slip)
        .otherwise(argument_hint(t, h))
    )
    return made.withColumn("repair_hint", hint)


def quotas(total: int, weights: dict[str, float]) -> dict[str, int]:
    """floor(total * weight) for each, the last takes the remainder."""
    names = list(weights)
    out = {n: int(total * weights[n]) for n in names[:-1]}
    out[names[-1]] = total - sum(out.values())
    return out


def synthesise(templates: DataFrame, counts: dict[str, int], names: list[str]) -> DataFrame:
    """Statements by category: templates are cycled, every second row gets renamed variables.

    templates: (category, template_id, statement, proof). ``{n}`` is the row's number.
    """
    spark = templates.sparkSession
    want = spark.createDataFrame(list(counts.items()), "category string, wanted int")
    from pyspark.sql import Window

    w = Window.partitionBy("category")
    t = templates.withColumn("slot", F.row_number().over(w.orderBy("template_id")) - 1).withColumn("per", F.count("*").over(w))
    rows = t.join(F.broadcast(want), "category").withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.col("wanted") - 1, F.lit(0))))).where((F.col("wanted") > 0) & (F.pmod("i", "per") == F.col("slot")))
    fresh = F.get(F.array(*map(F.lit, names)), (F.col("i") % len(names)).cast("int"))
    statement = F.replace("statement", F.lit("{n}"), F.col("i").cast("string"))
    renamed = F.when(F.col("i") % 2 == 1, F.regexp_replace(statement, r"\bx\b", fresh)).otherwise(statement)
    source = F.when(F.col("i") % 2 == 1, "synthetic_renamed").when(F.col("i") >= F.col("per"), "synthetic_variant").otherwise("synthetic")
    return rows.select("category", "template_id", "i", renamed.alias("theorem_statement"), source.alias("source"))
