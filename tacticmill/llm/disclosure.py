"""Personal information inside free text.

``personal_items`` finds names, email addresses, phone numbers, identity
numbers and street addresses; ``sanitised`` puts typed placeholders in their place and
leaves the rest of the text as it is.

Method. Information-theoretic sanitisation. Every text yields candidate spans
by form, with terms (the parts of a name, the shape of a number, the town and kind of
street, the host of an address of mail) and contexts (the tokens to the left and right). What states its kind by
itself (a title, a country code, a postal code ...) counts as a protected
entity. How much a term or context discloses is counted over the corpus:
log2 P(entity | term) / P(entity), in bits, where P(entity | term) is taken over all
occurrences of the term, as a word too. A candidate is an item if its terms and contexts
together disclose more than THRESHOLD bits (terms against the share of its kind among all candidates, contexts
against the share of entities within the kind) and none of its terms speaks strongly against it; that holds
for the stated ones as well.

Few entities state themselves, so a context never seen with a stated one says nothing yet. A
candidate that states nothing therefore counts in its contexts as an entity by the
least P(entity | term) of its terms seen elsewhere; in the second round the items of the first count as entities and the others as none. A candidate's own
occurrence is left out of the counts it is judged by. Of overlapping readings of a text
those stay whose terms disclose most together.

Scale. One pass over the texts writes the candidates and partial word counts; counts are partial
aggregates and joins on terms, and a term that a third of all rows hold is one row of the counts.
Only the five kinds' shares of entities among candidates reach the driver.

Defined results: a row without a key has no items; NULL and empty texts have none; positions count code
points of the text as it is; items of one text do not overlap; repeated rows give the same
items and count once; an empty table gives no items; texts are read whole.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tacticmill.llm.disclosure_rules import bare, candidates, words
from tacticmill.session import cut

THRESHOLD = 1.0  # bits that terms and contexts disclose together
FLOOR = -5.0  # the most that a context says against a candidate
VETO = -6.0  # no item has a term below
WEIGHT = 1.0  # occurrences that the prior share counts for
ROUNDS = 2
PLACEHOLDER = {"name": "[NAME]", "email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]"}

_WORDS = 100_000  # words counted before a partial count is written
_SCAN = "doc_id long, kind string, start_pos long, end_pos long, seed string, terms array<string>, contexts array<string>, closed string, second string, short_end long, n long"
_COLUMNS = ["doc_id", "kind", "start_pos", "end_pos", "seed", "terms", "contexts", "closed", "second", "short_end", "n"]
_ID = ["doc_id", "as_kind", "start_pos", "end_pos"]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    columns = dict(zip(_COLUMNS, zip(*rows)))
    # a list of integers and None must not pass through floats
    return pd.DataFrame({c: pd.array(v, dtype="Int64") if c in ("doc_id", "start_pos", "end_pos", "short_end", "n") else list(v) for c, v in columns.items()})


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter[str] = Counter()

    def counted() -> list[tuple]:
        rows = [(None, "word", None, None, w, None, None, None, None, None, n) for w, n in counts.items()]
        counts.clear()
        return rows

    for batch in batches:
        rows: list[tuple] = []
        for doc, text in zip(batch["doc_id"], batch["text"]):
            if not text:
                continue
            plain = bare(text)
            counts.update(words(plain))
            rows += [(doc, *c, 1) for c in candidates(plain)]
            if len(counts) > _WORDS:
                rows += counted()
        if rows:
            yield _frame(rows)
    if counts:
        yield _frame(counted())


def _bits(hits: Column, n: Column, share: Column) -> Column:
    return F.log2((hits + WEIGHT * share) / (n + WEIGHT) / share)


def _lookup(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(v) for kv in values.items() for v in kv])[F.col("as_kind")] if values else F.lit(0.5)


def _term_view(rows: DataFrame, terms: DataFrame, hits: DataFrame, share: Column) -> DataFrame:
    """rows with the bits of their terms: the least and the sum, and the least P(entity | term) of those seen elsewhere.

    terms: (as_kind, term, n); hits: (as_kind, term, hits); own: whether the row itself is one of the hits.
    """
    counts = terms.join(hits, ["as_kind", "term"], "left").select("as_kind", "term", "n", F.coalesce("hits", F.lit(0)).alias("hits"))
    others = F.col("hits") - F.col("own")
    seen = rows.withColumn("term", F.explode("terms")).join(counts, ["as_kind", "term"]).withColumn("bits", F.round(_bits(others, F.greatest(F.col("n") - 1, others), share), 6))
    keep = [F.first(c).alias(c) for c in ("own", "stated", "terms", "contexts")]
    chance = F.pow(F.lit(2.0), F.coalesce(F.min(F.when(F.col("n") > 1, F.col("bits"))), F.lit(0.0))) * F.first(share)
    return seen.groupBy(*_ID).agg(F.min("bits").alias("least"), F.sum("bits").alias("term_bits"), F.sum(F.greatest("bits", F.lit(0.0))).alias("told"), chance.alias("chance"), *keep)


def _placed(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.posexplode("contexts").alias("slot", "context"))


def _judged(seen: DataFrame, places: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """(id, stated, told, bits) of the candidates that terms and contexts disclose.

    seen: candidates no term of which speaks strongly against, with view, the part of an entity each
    counts for; places: (as_kind, slot, context, n) over all candidates; sizes: candidates by kind.
    """
    # at most five kinds
    viewed = {r["as_kind"]: r["v"] for r in seen.groupBy("as_kind").agg(F.sum("view").alias("v")).collect()}
    share = _lookup({k: ((viewed.get(k) or 0) + 0.5) / (n + 1) for k, n in sizes.items()})
    hits = _placed(seen.select("as_kind", "contexts", "view")).groupBy("as_kind", "slot", "context").agg(F.sum("view").alias("hits"))
    counts = hits.join(places, ["as_kind", "slot", "context"])
    both = _placed(seen.select(*_ID, "view", "least", "term_bits", "told", "stated", "contexts")).join(counts, ["as_kind", "slot", "context"])
    # sums of shares may differ in their last bits from run to run
    bits = F.round(_bits(F.greatest(F.col("hits") - F.col("view"), F.lit(0.0)), F.col("n") - 1, share), 6)
    both = both.select(*_ID, "least", "term_bits", "told", "stated", "slot", (F.col("n") - 1).alias("n"), F.greatest(bits, F.lit(FLOOR)).alias("bits"))

    def side(one: int, two: int) -> Column:
        """The bits of two tokens where they were seen four times elsewhere, else those of one."""
        long = F.max(F.when((F.col("slot") == two) & (F.col("n") >= 4), F.col("bits")))
        return F.coalesce(long, F.max(F.when(F.col("slot") == one, F.col("bits"))))

    scored = both.groupBy(*_ID).agg(F.first("term_bits").alias("term_bits"), F.first("told").alias("told"), F.first("stated").alias("stated"), (side(0, 1) + side(2, 3)).alias("placed"))
    scored = scored.withColumn("bits", F.col("term_bits") + F.col("placed"))
    return scored.where((F.col("stated") == 1) | (F.col("stated") == 0) & (F.col("bits") > THRESHOLD)).select(*_ID, "stated", "told", "bits")


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _best_readings(readings: pd.Series) -> pd.Series:
    """True for the readings of a text that do not overlap and together weigh most."""
    out = []
    for spans in readings:
        order = sorted(range(len(spans)), key=lambda i: (spans[i]["end_pos"], spans[i]["start_pos"], spans[i]["as_kind"]))
        ends, best, taken = [], [0.0], [(-1, 0)]
        for i in order:
            before = bisect_right(ends, spans[i]["start_pos"])
            w = best[before] + spans[i]["weight"]
            ends.append(spans[i]["end_pos"])
            if w > best[-1]:
                best.append(w)
                taken.append((i, before))
            else:
                best.append(best[-1])
                taken.append((-1, len(best) - 2))
        kept, at = [False] * len(order), len(order)
        while at:
            i, at = taken[at]
            if i >= 0:
                kept[i] = True
        out.append(kept)
    return pd.Series(out, dtype=object)


def _apart(items: DataFrame) -> DataFrame:
    """Of overlapping readings those that weigh most together; the items of a text are bounded by its length."""
    weight = F.round(F.col("told") + 0.1 * F.greatest("bits", F.lit(0)), 6) + 0.01
    readings = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "as_kind", "stated", weight.alias("weight")))).alias("all"))
    kept = readings.select("doc_id", F.explode(F.arrays_zip(F.col("all").alias("i"), _best_readings("all").alias("kept"))).alias("z")).where("z.kept").select("doc_id", "z.i")
    return kept.select("doc_id", "i.as_kind", "i.start_pos", "i.end_pos", "i.stated")


def disclosed(found: DataFrame) -> DataFrame:
    """(id, stated) of the items among the candidates of a scan.

    All candidates are joined with the counts of terms once; what a term speaks strongly against is in the
    counts, but is no item in any round and is not carried on.
    """
    spoken = found.where("kind = 'word'").groupBy(F.col("seed").alias("term")).agg(F.sum("n").alias("spoken"))
    kinds = F.when(F.col("kind") == "number", F.array(F.lit("phone"), F.lit("id_number"))).otherwise(F.array("kind"))
    # stated: 1 as this kind, -1 as another, which it then is not, 0 open
    stated = F.when(F.col("seed") == F.col("as_kind"), 1).when(F.col("seed") != "", -1).otherwise(0)
    rows = found.where("kind <> 'word'").withColumn("as_kind", F.explode(kinds)).select(*_ID, "terms", "contexts", stated.alias("stated"))
    rows = rows.withColumn("own", F.when(F.col("stated") == 1, 1).otherwise(0))
    # at most five kinds
    counted = rows.groupBy("as_kind").agg(F.count("*").alias("n"), F.sum("own").alias("hits")).collect()
    sizes = {r["as_kind"]: r["n"] for r in counted}

    def among_all(hits: dict[str, int]) -> Column:
        return _lookup({k: ((hits.get(k) or 0) + 0.5) / (sum(sizes.values()) + 1) for k in sizes})

    counts = rows.select("as_kind", "own", F.explode("terms").alias("term")).groupBy("as_kind", "term").agg(F.count("*").alias("n"), F.sum("own").alias("hits")).join(spoken, "term", "left")
    counts = cut(counts.select("as_kind", "term", "hits", F.greatest("n", F.coalesce("spoken", F.lit(0))).alias("n")), "items-terms")
    places = cut(_placed(rows.select("as_kind", "contexts")).groupBy("as_kind", "slot", "context").agg(F.count("*").alias("n")), "items-places")
    first = _term_view(rows, counts.drop("hits"), counts.select("as_kind", "term", "hits"), among_all({r["as_kind"]: r["hits"] for r in counted})).where(F.col("least") > VETO)
    view = F.when(F.col("stated") == 1, 1.0).when(F.col("stated") == -1, 0.0).otherwise(F.least("chance", F.lit(1.0)))
    seen = cut(first.withColumn("view", view), "items-view")
    items = cut(_apart(_judged(seen, places, sizes)), "items-round")
    left = seen.select(*_ID, "terms", "contexts", "stated")
    for _ in range(ROUNDS - 1):
        again = left.join(items.select(*_ID, F.lit(1).alias("item")), _ID, "left").withColumn("own", F.coalesce("item", F.lit(0))).drop("item")
        again = cut(again, "items-again")
        hits = again.where("own = 1").select("as_kind", F.explode("terms").alias("term")).groupBy("as_kind", "term").agg(F.count("*").alias("hits"))
        held = {r["as_kind"]: r["count"] for r in again.where("own = 1").groupBy("as_kind").count().collect()}
        seen = _term_view(again, counts.drop("hits"), hits, among_all(held)).where(F.col("least") > VETO)
        seen = cut(seen.withColumn("view", F.col("own").cast("double")), "items-view")
        items = cut(_apart(_judged(seen, places, sizes)), "items-round")
    return items


def _town_ends(found: DataFrame) -> DataFrame:
    """(doc_id, start_pos, end_pos, town_end) of addresses; the town is cut to one word unless the corpus knows the second as part of it.

    It does if the first is mostly followed by it where something closes the town; where the first is never closed,
    if the second word is mostly said in this place.
    """
    a = found.where("kind = 'address'").select("doc_id", "start_pos", "end_pos", "closed", "short_end", F.col("terms")[0].alias("w1"), F.col("second").alias("w2"))
    towns = a.where("closed <> 'open'").groupBy("w1").agg(F.count("*").alias("n"))
    pairs = a.where("w2 is not null and closed <> 'open'").groupBy("w1", "w2").agg(F.count("*").alias("n12"))
    spoken = found.where("kind = 'word'").groupBy(F.col("seed").alias("w2")).agg(F.sum("n").alias("spoken"))
    seconds = a.where("w2 is not null").groupBy("w2").agg(F.count("*").alias("n2")).join(spoken, "w2", "left")
    known = a.join(towns, "w1", "left").join(pairs, ["w1", "w2"], "left").join(seconds, "w2", "left")
    told = F.coalesce(F.coalesce("n12", F.lit(0)) * 2 >= F.col("n"), F.col("n2") * 2 > F.coalesce("spoken", F.lit(0)), F.lit(True))
    both = (F.col("closed") == "coded") | F.col("w2").isNull() | told
    return known.select("doc_id", "start_pos", "end_pos", F.when(both, F.col("end_pos")).otherwise(F.col("short_end")).alias("town_end"))


def scanned(df: DataFrame, key: str, text: str) -> DataFrame:
    """One pass over the texts: candidates, and partial counts of words."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return cut(rows.mapInPandas(_extract, _SCAN), "items")


def personal_items(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, kind, start_pos, end_pos), one row for each item; doc_id is named like key."""
    scan = scanned(df, key, text)
    # repeated rows count once; words have no position
    once = scan.where("kind <> 'word'").dropDuplicates(["doc_id", "kind", "start_pos", "end_pos"])
    found = cut(once.unionByName(scan.where("kind = 'word'")), "items-once")
    items = disclosed(found).withColumnRenamed("as_kind", "kind")
    ends = _town_ends(found).withColumn("kind", F.lit("address"))
    out = items.join(ends, ["doc_id", "kind", "start_pos", "end_pos"], "left").select("doc_id", "kind", "start_pos", F.coalesce("town_end", "end_pos").alias("end_pos"))
    return out.withColumnRenamed("doc_id", key)


@F.pandas_udf(T.StringType())
def _replaced(texts: pd.Series, items: pd.Series) -> pd.Series:
    out = []
    for text, spans in zip(texts, items):
        if text is None or spans is None or not len(spans):
            out.append(text)
            continue
        parts, at = [], 0
        for s in sorted(spans, key=lambda s: s["start_pos"]):
            parts += [text[at : s["start_pos"]], PLACEHOLDER[s["kind"]]]
            at = s["end_pos"]
        out.append("".join(parts) + text[at:])
    return pd.Series(out, dtype=object)


def sanitised(df: DataFrame, items: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) of every row, items replaced by placeholders. A text's items are bounded by its length.

    A row without a key has no items, so its text comes out as NULL rather than as it is.
    """
    spans = items.groupBy(key).agg(F.collect_list(F.struct("start_pos", "end_pos", "kind")).alias("spans"))
    return df.select(key, text).join(spans, key, "left").select(key, F.when(F.col(key).isNotNull(), _replaced(F.col(text), F.col("spans"))).alias(text))
