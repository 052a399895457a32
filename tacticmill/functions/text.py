"""Text functions on columns; all stay in the JVM. NULL stays NULL unless stated."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Heads of tactics that mark a landmark step.
KEY_TACTICS = ["have", "apply", "rw", "simp", "exact", "intro", "cases", "induction", "constructor", "refine", "calc", "obtain"]

# Names a tactic may cite that are no premises.
NOT_PREMISES = [
    "this", "self", "fun", "by", "with", "at", "using", "True", "False", "And", "Or", "Not", "Iff", "Exists", "show", "from", "have", "let",
    "match", "do", "return", "where", "if", "then", "else", "for", "in", "Type", "Prop", "Sort", "Set", "H", "H1", "H2", "H3", "IH", "IHn", "IHm",
]

# Classes of kernel messages, the first match counts.
ERROR_CLASSES = [
    ("type mismatch", "TYPE_MISMATCH"),
    ("has type.*but is expected to have type", "TYPE_MISMATCH"),
    ("unknown identifier", "UNKNOWN_IDENTIFIER"),
    ("unknown constant", "UNKNOWN_IDENTIFIER"),
    ("tactic .* failed", "TACTIC_FAILED"),
    ("unsolved goals", "UNSOLVED_GOALS"),
    ("timeout", "TIMEOUT"),
    ("expected token", "PARSE_ERROR"),
    ("unexpected token", "PARSE_ERROR"),
    ("elaboration error", "ELABORATION_ERROR"),
    ("don't know how to synthesize", "ELABORATION_ERROR"),
    ("failed to synthesize", "ELABORATION_ERROR"),
    ("\\?m\\.[0-9]+", "METAVAR_UNRESOLVED"),
    ("unresolved.*metavar", "METAVAR_UNRESOLVED"),
]
CONFIDENCE = {"TYPE_MISMATCH": 0.8, "UNKNOWN_IDENTIFIER": 0.9, "TACTIC_FAILED": 0.7, "UNSOLVED_GOALS": 0.6, "PARSE_ERROR": 0.95, "ELABORATION_ERROR": 0.6, "METAVAR_UNRESOLVED": 0.5, "TIMEOUT": 0.85, "OTHER": 0.3}

# Classes and number of failures at which a tactic is given up, and signs that combine tactics.
GIVE_UP_CLASSES, GIVE_UP_AFTER = ("ELABORATION_ERROR", "METAVAR_UNRESOLVED", "TIMEOUT"), 3
COMBINATORS = ["<;>", ";", "·", ">>", "|||"]

#: An identifier: Unicode letters and digits after an ASCII start, dots inside.
IDENTIFIER = r"[A-Za-z_][\p{L}\p{N}_.]*"
PREMISE = r"@?[A-Z][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*"


def strip(x: Column) -> Column:
    """Without white space at both ends (not only blanks)."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def blank(x: Column) -> Column:
    """True for NULL, empty and white space."""
    return F.coalesce(strip(x), F.lit("")) == ""


def text(x: Column) -> Column:
    """NULL as the empty string."""
    return F.coalesce(x, F.lit(""))


def first_token(x: Column) -> Column:
    """First word of a tactic, past one bullet or combinator; ``<empty>`` if there is none."""
    head = F.regexp_extract(text(x), r"^\s*(?:(?:·|<;>|--|\|)\s+)?(\S+)", 1)
    return F.when(head == "", F.lit("<empty>")).otherwise(head)


def last_segments(name: Column, n: int) -> Column:
    """The last n dot segments of a qualified name."""
    return F.substring_index(name, ".", -n)


def truncated(x: Column, n: int, marker: str = "...") -> Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit(marker))).otherwise(x)


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts joined by a bar; NULL parts count as empty, so they cannot shift the others."""
    return F.sha2(F.concat_ws("|", *[text(p) for p in parts]), 256)


def normalised_hash(x: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the white-space-normalised text."""
    return F.substring(F.sha2(strip(F.regexp_replace(text(x), r"\s+", " ")), 256), 1, 16)


def hash_number(*parts: Column) -> Column:
    """Unsigned 32-bit number from MD5, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat(*[text(p) for p in parts])), 1, 8), 16, 10).cast("long")


def hash_unit(*parts: Column) -> Column:
    """hash_number scaled to [0, 1)."""
    return hash_number(*parts) / F.lit(4294967296.0)


def module_of(path: Column) -> Column:
    """Dotted module of a source path: what follows the last ``src/`` or the library root, without suffix."""
    bare = F.regexp_replace(path, r"\.[A-Za-z0-9]+$", "")
    return F.translate(F.regexp_replace(bare, r"^.*?/?([A-Z][A-Za-z0-9_]*(?:/[A-Za-z0-9_]+)*)$", "$1"), "/", ".")


def identifiers(x: Column) -> Column:
    """Distinct identifiers of a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text(x), F.lit(f"({IDENTIFIER})"), 1)))


def metavariables(x: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text(x), F.lit(r"(\?\w+\.\d+)"), 1)))


def goal_summary(state: Column) -> Column:
    """From the first turnstile, at most 200 characters; else the first 150; ``(empty state)`` for nothing."""
    at = F.locate("⊢", state)
    goal = strip(F.substring(state, at, F.length(state)))
    head = strip(F.substring(state, 1, 150))
    return F.when(text(state) == "", F.lit("(empty state)")).when(at > 0, truncated(goal, 200)).when(head == "", F.lit("(empty state)")).otherwise(head)


def hypotheses(state: Column) -> Column:
    """``name : type`` of the lines before the turnstile: types cut at 60 characters, names shorter than 30."""
    lines = F.split(F.substring_index(text(state), "⊢", 1), "\n")
    own = F.filter(F.transform(lines, strip), lambda l: (l != "") & ~l.startswith("case ") & ~l.startswith("context") & l.contains(":"))
    pairs = F.transform(own, lambda l: F.struct(strip(F.substring_index(l, ":", 1)).alias("n"), strip(F.substring(l, F.locate(":", l) + 1, F.length(l))).alias("t")))
    kept = F.filter(pairs, lambda p: (p["n"] != "") & (F.length(p["n"]) < 30))
    shown = F.transform(kept, lambda p: F.concat(p["n"], F.lit(" : "), truncated(p["t"], 60)))
    return F.when(F.locate("⊢", text(state)) > 0, shown).otherwise(F.array().cast("array<string>"))


def hypotheses_clause(state: Column, most: int = 4) -> Column:
    all_of = hypotheses(state)
    n = F.size(all_of)
    shown = F.array_join(F.slice(all_of, 1, most), ", ")
    more = F.when(n > most, F.concat(F.lit(", ... ("), (n - most).cast("string"), F.lit(" more)"))).otherwise(F.lit(""))
    return F.when(n > 0, F.concat(F.lit(" (with hypotheses "), shown, more, F.lit(")"))).otherwise(F.lit(""))


def message_summary(message: Column) -> Column:
    """First line of more than five characters, at most 120, without quotes at its ends."""
    bare = strip(text(message))
    lines = F.filter(F.transform(F.split(bare, "\n"), strip), lambda l: F.length(l) > 5)
    first = F.coalesce(F.get(lines, F.lit(0)), bare)
    short = F.when(F.length(first) > 120, F.concat(F.substring(first, 1, 117), F.lit("..."))).otherwise(first)
    unquoted = F.regexp_replace(short, "^[\"']+|[\"']+$", "")
    return F.when(unquoted == "", F.lit("an elaboration error")).otherwise(unquoted)


def intro_names(state: Column) -> Column:
    """Names before `` : `` in the lines before the goal, without inaccessible ones."""
    lines = F.split(F.substring_index(text(state), "⊢", 1), "\n")
    names = F.transform(F.filter(F.transform(lines, strip), lambda l: l.contains(" : ")), lambda l: strip(F.substring_index(l, " : ", 1)))
    return F.filter(names, lambda n: (n != "") & ~n.contains("✝") & ~n.rlike("^[0-9]"))


def intro_like(tactic: Column) -> Column:
    return F.lower(strip(text(tactic))).rlike(r"^(intro|intros|(intro|intros|rintro) .*)$")


def without_repeats(name: Column) -> Column:
    """A qualified name with adjacent equal segments collapsed."""
    parts = F.split(name, r"\.")
    return F.array_join(F.filter(parts, lambda s, i: (i == 0) | (s != F.get(parts, i - 1))), ".")


def run_capped(items: Column, most: int = 2) -> Column:
    """At most two equal items in a row."""
    return F.filter(items, lambda x, i: ~((i >= most) & (x == F.get(items, i - 1)) & (x == F.get(items, i - 2))))


def error_class(message: Column) -> Column:
    low = F.lower(text(message))
    out = F.when(F.lit(False), F.lit(""))
    for pattern, label in ERROR_CLASSES:
        out = out.when(low.rlike(f"(?s){pattern}"), F.lit(label))
    return out.otherwise(F.lit("OTHER"))


def repair_route(label: Column, failures: Column) -> Column:
    return F.when(label.isin(*GIVE_UP_CLASSES) | (failures >= GIVE_UP_AFTER), F.lit("ESR")).otherwise(F.lit("ETR"))


def route_of(message: str, failures: int) -> tuple[str, str]:
    """(class, route) of one message; the same rules as the columns', for use beside an external kernel."""
    low = (message or "").lower()
    label = next((label for pattern, label in ERROR_CLASSES if re.search(pattern, low, re.S)), "OTHER")
    return label, "ESR" if label in GIVE_UP_CLASSES or failures >= GIVE_UP_AFTER else "ETR"


def unwrapped_message(message: Column) -> Column:
    """What stands between data=' and the next quote, if anything does; else the message."""
    inner = F.regexp_extract(text(message), r"(?s)data='([^']+)'", 1)
    return F.when(inner != "", inner).otherwise(text(message))


def single_tactic(x: Column) -> Column:
    """(name, combinator) of a tactic: its first word, or all of it if it starts with none, and whether it combines others."""
    t = strip(text(x))
    head = F.regexp_extract(t, r"^([\p{L}\p{N}_]+)", 1)
    combines = F.lit(False)
    for sign in COMBINATORS:
        combines = combines | F.contains(t, F.lit(sign))
    return F.struct(F.when(head != "", head).otherwise(t).alias("name"), combines.alias("combinator"))


def confidence(label: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in CONFIDENCE.items() for v in pair])
    return F.coalesce(F.try_element_at(table, label), F.lit(0.3))


def tactic_identifiers(tactic: Column) -> Column:
    """What a tactic names: items in brackets and dotted words; else its first word past the head; else itself."""
    t = strip(text(tactic))
    inside = F.flatten(F.transform(F.regexp_extract_all(t, F.lit(r"\[([^\]]+)\]"), 1), lambda b: F.split(b, ",")))
    bracket = F.filter(F.transform(inside, lambda p: F.regexp_replace(strip(p), "^[←↔]\\s*", "")), lambda p: F.length(p) > 2)
    words = F.filter(F.transform(F.split(F.regexp_replace(t, r"[\[\]]", " "), r"\s+"), lambda w: F.regexp_replace(w, r"^[(),;]+|[(),;]+$", "")), lambda w: w != "")
    dotted = F.filter(words, lambda w: (F.length(w) > 2) & w.contains(".") & ~w.startswith("-"))
    own = F.concat(bracket, dotted)
    plain = F.slice(F.filter(words, lambda w: (F.length(w) > 2) & ~F.lower(w).isin(*TACTIC_WORDS)), 1, 1)
    return F.when(F.size(own) > 0, own).when(F.size(plain) > 0, plain).when(t != "", F.array(t)).otherwise(F.array().cast("array<string>"))


# Heads of tactics that name nothing.
TACTIC_WORDS = [
    "exact", "apply", "rw", "simp", "intro", "intros", "have", "let", "show", "calc", "constructor", "cases", "induction", "refl", "ring", "omega", "norm_num",
    "ext", "funext", "congr", "trivial", "assumption", "contradiction", "exfalso", "by_contra", "push_neg", "linarith", "nlinarith", "field_simp", "ring_nf",
]

# One pattern for each form of citing a single name, and one for each form of citing a bracketed list.
SINGLE_CITATIONS = [
    rf"(?i)(?:exact|exact\?)\s+({PREMISE})",
    rf"(?i)apply\s+({PREMISE})",
    rf"(?i)refine'?\s+({PREMISE})",
    rf"(?i)have\s+[^:=]*:=\s+({PREMISE})",
    rf"(?i)(?:obtain|rcases)\s+.*(?:using|with)\s+({PREMISE})",
    rf"(?i)convert\s+(?:←\s*)?({PREMISE})",
    rf"(?i)trans\s+({PREMISE})",
    rf"(?i)gcongr\s+(?:.*\s+)?({PREMISE})",
]
LIST_CITATIONS = [r"(?i)(?:rw|rewrite)\s+\[([^\]]+)\]", r"(?i)simp\s+(?:only\s+)?\[([^\]]+)\]", r"(?i)(?:n?linarith)\s+\[([^\]]+)\]", r"(?i)norm_num\s+\[([^\]]+)\]"]


def split_outside_brackets(x: Column) -> Column:
    """Items of a comma list; commas inside brackets do not separate. Depth is folded over the comma pieces."""
    pieces = F.split(x, ",")
    opened = lambda s: F.length(F.regexp_replace(s, r"[^(\[{]", "")) - F.length(F.regexp_replace(s, r"[^)\]}]", ""))
    zero = F.struct(F.array().cast("array<string>").alias("items"), F.lit("").alias("part"), F.lit(0).alias("depth"))

    def step(acc: Column, s: Column) -> Column:
        part = F.when(acc["part"] == "", s).otherwise(F.concat(acc["part"], F.lit(","), s))
        depth = acc["depth"] + opened(s)
        return F.struct(
            F.when(depth <= 0, F.concat(acc["items"], F.array(part))).otherwise(acc["items"]).alias("items"),
            F.when(depth <= 0, F.lit("")).otherwise(part).alias("part"),
            F.greatest(depth, F.lit(0)).alias("depth"),
        )

    folded = F.aggregate(pieces, zero, step, lambda acc: F.when(acc["part"] != "", F.concat(acc["items"], F.array(acc["part"]))).otherwise(acc["items"]))
    return F.filter(F.transform(folded, strip), lambda s: s != "")


def valid_premise(name: Column) -> Column:
    return (F.length(name) >= 2) & ~name.isin(*NOT_PREMISES) & ~((name == F.lower(name)) & name.rlike("[a-z]") & ~name.contains(".")) & ~name.rlike("^[0-9]+$")


def premises(tactic: Column) -> Column:
    """Names of premises a tactic cites, distinct and sorted. Single citations ignore case, items of lists start in upper case."""
    t = text(tactic)
    single = [F.transform(F.regexp_extract_all(t, F.lit(p), 1), lambda n: F.regexp_replace(n, "^@+", "")) for p in SINGLE_CITATIONS]
    listed = [F.flatten(F.transform(F.regexp_extract_all(t, F.lit(p), 1), split_outside_brackets)) for p in LIST_CITATIONS]
    heads = [F.transform(items, lambda s: F.regexp_extract(F.regexp_replace(s, r"^[←]*-*\s*@*", ""), r"^([A-Z][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)", 1)) for items in listed]
    return F.array_sort(F.array_distinct(F.filter(F.concat(*single, *heads), valid_premise)))


def filled(template: Column, **values: Column) -> Column:
    """Literal replacement of ``{key}`` for the given keys only, in the given order; other braces stay."""
    out = template
    for key, value in values.items():
        out = F.replace(out, F.lit("{" + key + "}"), text(value))
    return out
