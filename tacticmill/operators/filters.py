"""Row filters as conditions, and counters of what they drop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tacticmill.functions.text import blank, strip, tactic_identifiers, text

# Words by which a text mentions a kind of error.
TYPE_WORDS = {
    "tactic_typo": ["typo", "spelling", "misspell"],
    "wrong_tactic": ["wrong", "inappropriate", "mismatch", "incorrect tactic"],
    "argument_error": ["argument", "parameter", "type mismatch"],
    "missing_step": ["missing", "intermediate", "skip", "gap"],
}


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def usable_proof(steps: Column, tactics: Column, least: int = 2, most: int = 200) -> Column:
    return steps.between(least, most) & ~F.exists(tactics, lambda t: t.contains("sorry") | t.contains("native_decide"))


def bad_record(thought: Column, tactic: Column, before: Column, after: Column) -> Column:
    """Reason a record is dropped, or NULL."""
    return F.when(text(thought) == "", "thought").when(text(tactic) == "", "tactic").when(text(before) == "", "state_before").when(text(after) == "", "state_after").when(strip(tactic) == "sorry", "sorry")


def text_quality(x: Column, forbidden: list[str], required: list[str], least: int = 20, most: int = 500, ignore_case: bool = False) -> Column:
    """Length within bounds, no forbidden part, some required word."""
    hay = F.lower(x) if ignore_case else x
    banned = any_of([hay.contains(p.lower() if ignore_case else p) for p in forbidden])
    needed = any_of([x.contains(w) for w in required]) if required else F.lit(True)
    return F.coalesce(F.length(x).between(least, most) & ~banned & needed, F.lit(False))


def status_ok(status: Column, wanted: list[str] | None = None, prefix: str = "verified") -> Column:
    return F.coalesce(status.isin(*wanted) if wanted else status.startswith(prefix), F.lit(False))


def required(*fields: str) -> Column:
    return all_of([~blank(F.col(f)) for f in fields])


def mentions(hay: Column, needles: Column) -> Column:
    low = F.lower(hay)
    return F.exists(needles, lambda n: low.contains(F.lower(n)))


def consistent(reflection: Column, original: Column, error: Column, error_type: Column) -> Column:
    """The text names the right tactic, or something it names, or the wrong one together with the kind of error."""
    o, e = strip(text(original)), strip(text(error))
    words = F.create_map(*[v for k, ws in TYPE_WORDS.items() for v in (F.lit(k), F.array(*map(F.lit, ws)))])
    kind = F.coalesce(F.try_element_at(words, error_type), F.array(text(error_type)))
    wrong = (e != "") & (reflection.contains(e) | mentions(reflection, tactic_identifiers(e)))
    return F.coalesce((o == "") | reflection.contains(o) | mentions(reflection, tactic_identifiers(o)) | wrong & mentions(reflection, kind), F.lit(False))


def dropped(df: DataFrame, reason: Column) -> DataFrame:
    """(reason, n) counts, kept rows under ``kept``."""
    return df.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def completeness(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, present, missing); NULL and empty are missing. One pass, one row for each field."""
    one = df.agg(F.count("*").alias("n"), *[F.count_if(text(F.col(f).cast("string")) != "").alias(f) for f in fields])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("present"), (F.col("n") - F.col(f)).alias("missing")) for f in fields])).alias("r")).select("r.*")
