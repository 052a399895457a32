"""Template residue, filler, error pages and notices standing where text should be.

``residue_cases`` finds the records and fields of a text table that hold such
residue, wholly or in part.

Method. Labelled exemplars of residue are kept in an inverted index from token
to exemplar; every shape of template markup (``{{name}}``, ``${name}``,
``<% %>``, ``[state_3]`` ...) is one token and an exemplar of its own, filler is indexed by the first letters of its words. A line retrieves the exemplars
that share a token with it. Each is scored against windows of the line's tokens as wide as the exemplar,
slid over the whole line, by TF-IDF containment, the idf mass of the
exemplar found in the window, and by coverage, the idf mass of the window that
the exemplar explains; signs and names that every state holds weigh nearly nothing, rare ones next to a shape speak against it.
A field is a case if one of its windows is covered. Document frequencies are
those of all lines of all texts handed over.

One pass over the texts writes the few windows that retrieve anything and the
partial counts of all tokens. The counts are summed in a distributed aggregate
and joined to the windows, so every word has its own idf and coverage depends on shares,
not on the number of rows; only the counts of exemplar tokens are gathered, at most one row each.

Defined results: a row without an id is no record; NULL and empty texts are no case; notes that nothing is left
to prove, ASCII states and mathematics with braces, brackets, string literals
or such words as names are no case; repeated rows count once; an empty table
gives no case; every text is read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tacticmill.session import cut

CONTAINMENT, COVERAGE = 0.7, 0.6  # of an exemplar in a window, of the window by the exemplar or by filler
FILLED = 0.7  # of a line by one or two words

# Shapes of unfilled templates and of markup, by token.
MARKUP = {
    "<moustache>": r"\{\{[^{}\n]*\}\}",
    "<dollar>": r"\$\{[\w. ]+\}|(?<![\w$])\$[A-Za-z_]\w+",
    "<erb>": r"<%.*?%>",
    "<double_bracket>": r"\[\[\s*\w[\w. ]*\]\]",
    "<at>": r"@@\w+@@",
    "<dunder>": r"(?<!\w)__[A-Z][A-Z_]+__(?!\w)",
    "<percent>": r"(?<!\w)%[A-Z][A-Z_]+%|%\(\w+\)[sd]",
    "<brace>": r"(?<![∈∉⊆⊂∪∩\\=≠,(:|\w{]\s)(?<![∈∉⊆⊂∪∩\\=≠,(:|\w{])\{[a-z]{3,}(?:_[a-z]+)*\}|(?<=: )\{(?:type|goal|state|name|target|hyps?|hypotheses|expr|value|text)\}",
    "<numbered>": r"\{\d\} : \{\d\}|(?<=⊢ )\{\d\}\s*$|^\s*\{\d\}\s*$",
    "<here>": r"<(?:insert|your|put|add|enter)\b[^<>\n]*>|<[a-z][\w ]* here>|<(?:missing|placeholder|unknown|empty|todo|tbd)>",
    "<state_slot>": r"\[\s*state[ _-]?\d+\s*\]|\bstate_?\d+_placeholder\b",
    "<tbd_slot>": r"\[(?:tbd|todo|placeholder|missing|insert[^\[\]\n]*|fill[^\[\]\n]*)\]",
    "<object>": r"\[object \w+\]",
    "<ref>": r"#(?:REF|VALUE|NAME|N/A|DIV/0)[!?]?",
    "<tag>": r"<!DOCTYPE[^<>\n]*>|<!--.*?-->|</?(?:html|head|body|title|h\d|hr|p|b|i|br|div|span|script|noscript|meta|a|ul|li|table|tr|td)\b[^<>⟨⟩∀∃⊢\n]*>",
    "<json_error>": r"\{\s*\"(?:error|errors|status|message|detail)\"\s*:",
    "<traceback>": r"Traceback \(most recent call last\)|^\s*File \"[^\"\n]*\", line \d+|^[A-Z]\w*(?:Error|Exception): ",
    "<n_a>": r"(?<![\w/])[nN]/[aA](?![\w/])",
    "<run>": r"(?<!\w)([xX*#?])\1{5,}(?!\w)",
    "<repeated>": r"(?i)\b(asdf|qwerty|blah|foo|placeholder|lorem|text|dummy|test|todo)(?:\s+\1\b)+",
}

# Labelled exemplars of residue, as pages and forms at large word them. "_" stands for any word,
# "<http>" for a status code; every shape of MARKUP is an exemplar of its own.
EXEMPLARS = [
    ("notice", "please enable javascript"),
    ("notice", "need to enable javascript"),
    ("notice", "javascript is disabled"),
    ("notice", "javascript must be enabled"),
    ("notice", "javascript required"),
    ("notice", "requires javascript to be enabled"),
    ("notice", "please enable scripts"),
    ("notice", "please allow scripts"),
    ("notice", "with scripts turned on"),
    ("notice", "with scripts enabled"),
    ("notice", "scripting is off"),
    ("notice", "scripting is disabled"),
    ("notice", "scripts are blocked"),
    ("notice", "cookies are blocked"),
    ("notice", "please enable cookies"),
    ("loading", "loading please wait"),
    ("loading", "please wait while _ loading"),
    ("loading", "loading _ …"),
    ("loading", "checking your browser before"),
    ("loading", "checking your connection"),
    ("loading", "connection is secure before"),
    ("error", "internal server error"),
    ("error", "service unavailable"),
    ("error", "<http> service unavailable"),
    ("error", "bad gateway"),
    ("error", "<http> bad gateway"),
    ("error", "gateway timeout"),
    ("error", "page not found"),
    ("error", "<http> not found"),
    ("error", "error <http> _ _ page"),
    ("error", "access denied"),
    ("error", "session _ has expired"),
    ("error", "please log in again"),
    ("error", "too many requests"),
    ("error", "rate limit exceeded"),
    ("error", "request timed out"),
    ("error", "connection timed out"),
    ("error", "connection reset by peer"),
    ("error", "connection refused"),
    ("error", "the server is down"),
    ("error", "down for maintenance"),
    ("error", "not available in your region"),
    ("error", "not available in your country"),
    ("error", "quota exceeded for"),
    ("error", "<json_error> code <http>"),
    ("error", "something went wrong"),
    ("error", "an unexpected error occurred"),
    ("error", "nothing to display"),
    ("error", "warning undefined variable"),
    ("template", "generated from template"),
    ("template", "todo fill in"),
    ("template", "to be written"),
    ("template", "to be filled in"),
    ("template", "to be done"),
    ("template", "your _ goes here"),
    ("template", "insert _ here"),
    ("template", "replace with your"),
    ("template", "tbd"),
    ("template", "todo"),
    ("template", "placeholder"),
    ("filler", "undefined"),
    ("filler", "nan"),
    ("filler", "null"),
    ("filler", "none"),
    ("filler", "asdf"),
    ("filler", "blah"),
    ("filler", "<repeated> _"),
    ("filler", "sample text"),
    ("filler", "dummy text"),
]

# Fixed value: the usual filler passage and frequent words of its generators. Filler varies in its endings, so it is indexed by the first letters of its words.
FILLER = """lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud
    exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint
    occaecat cupidatat proident sunt culpa officia deserunt mollit anim est laborum vestibulum ante primis faucibus orci luctus turpis egestas porta rhoncus quam
    sapien viverra""".split()

_SHAPES = [(token, re.compile(pattern, re.I if token in ("<here>", "<state_slot>", "<tbd_slot>", "<tag>", "<json_error>") else 0)) for token, pattern in MARKUP.items()]
_HINT = re.compile(r"\{\{|\$|<%|\[\[|@@|__[A-Z]|%[A-Z(]|\{\w+\}|<[A-Za-z!/]|\[|#[A-Z]|[nN]/[aA]|placeholder|\{\s*\"|File \"|Traceback|Error: |Exception: |xxxxxx|XXXXXX|\*{6}|#{6}|\?{6}|(?i:asdf|qwerty|blah|foo|lorem|text|dummy|test|todo)")
_STRING = re.compile(r"\"[^\"\n]*\"")
_TOKEN = re.compile(r"[^\W\d]\w*(?:\.[^\W\d]\w*)*|…|\.\.\.$|(?<![\w.])[45]\d\d(?![\w.])|[:=∈∉⊆≤≥<>≠≈∣∧∨¬→←↔•⟨⟩∀∃+*|⊢]")
_VARIABLE = re.compile(r"\w[\d₀-₉✝'_]+|[^\W\d_][^\W\d_]?[₀-₉✝]+")
_STATE_SIGNS = frozenset(":=∈∉⊆≤≥<>≠≈∣∧∨¬→←↔•⟨⟩∀∃+*|")
_STEM = 3  # letters of a filler word that are indexed
SLACK = 2  # words put into an exemplar that a window may hold
FILLER_WINDOW = 6


class Exemplar(NamedTuple):
    label: str
    tokens: frozenset[str]
    width: int  # words, slots included
    slots: int  # any words
    markup: bool


def _bank() -> tuple[list[Exemplar], dict[str, list[int]]]:
    bank = [Exemplar("markup", frozenset([shape]), 1, 0, True) for shape in MARKUP]
    bank += [Exemplar(label, frozenset(text.split()) - {"_"}, len(text.split()), text.split().count("_"), False) for label, text in EXEMPLARS]
    postings: dict[str, list[int]] = defaultdict(list)
    for i, exemplar in enumerate(bank):
        for token in exemplar.tokens:
            postings[token].append(i)
    return bank, dict(postings)


BANK, POSTINGS = _bank()
STEMS = frozenset(w[:_STEM] for w in FILLER)


class _Tokens(dict):
    """Written form to token, remembered up to a number of forms."""

    def __missing__(self, raw: str) -> str:
        if len(self) > 200_000:
            self.clear()
        token = self[raw] = self._token(raw)
        return token

    @staticmethod
    def _token(raw: str) -> str:
        if raw[0].isdigit():
            return "<http>"
        if raw == "...":
            return "…"
        # a variable stands for all variables, a qualified name for its first part
        if len(raw) == 1 and raw.isalpha() or _VARIABLE.fullmatch(raw):
            return "<variable>"
        return raw.split(".", 1)[0].lower() + "." if "." in raw else raw.lower()


_TOKENS = _Tokens()


def line_tokens(line: str) -> list[str]:
    """Words, heads of qualified names, signs and shapes of markup of a line, in their order.

    Markup in string literals of a statement does not count.
    """
    if not _HINT.search(line):
        return [_TOKENS[t] for t in _TOKEN.findall(line)]
    rest = line if line.lstrip().startswith(("{", "<", "File", "Traceback")) else _STRING.sub(lambda m: '"' * len(m.group(0)), line)
    at: list[tuple[int, str]] = []
    for token, shape in _SHAPES:
        for m in shape.finditer(rest):
            if m.end() > m.start():
                at.append((m.start(), token))
        rest = shape.sub(lambda m: " " * len(m.group(0)), rest)
    return [t for _, t in sorted(at + [(m.start(), _TOKENS[m.group(0)]) for m in _TOKEN.finditer(rest)])]


def is_filler(token: str) -> bool:
    return len(token) > _STEM and token[:_STEM] in STEMS and token.isalpha()


def retrieves(tokens: list[str]) -> bool:
    """True where a line's tokens retrieve an exemplar."""
    if not POSTINGS.keys().isdisjoint(tokens):
        return True
    return len(tokens) >= 3 and sum([is_filler(t) for t in tokens if t[:_STEM] in STEMS]) >= 3


def _best(tokens: list[str], exemplar: Exemplar, mass: dict[str, float]) -> tuple[float, float]:
    """(containment, coverage) of the window that holds most of the exemplar, and of those the one it explains most of."""
    all_of_it = max(sum(mass.get(t, mass[""]) for t in exemplar.tokens), 1e-9)
    own = [mass[t] for t in tokens]
    best = (0.0, 0.0)
    reach = exemplar.width + SLACK
    for p, t in enumerate(tokens):
        if t not in exemplar.tokens:
            continue
        if exemplar.markup:
            # the most favourable window around the shape, of full width unless the line is shorter
            for start in range(max(0, p - reach + 1), min(p, max(0, len(tokens) - reach)) + 1):
                part = own[start : start + reach]
                best = max(best, (1.0, own[p] * sum(x == t for x in tokens[start : start + reach]) / max(sum(part), 1e-9)))
            continue
        held: set[str] = set()
        total = shared = 0.0
        slots = exemplar.slots
        for q in range(p, min(len(tokens), p + reach)):
            if tokens[q] not in exemplar.tokens and slots and tokens[q] not in _STATE_SIGNS:
                slots -= 1
                continue
            total += own[q]
            if tokens[q] in exemplar.tokens:
                shared += own[q]
                held.add(tokens[q])
                best = max(best, (sum(mass[h] for h in held) / all_of_it, shared / max(total, 1e-9)))
    return best


def covered(tokens: list[str], mass: dict[str, float]) -> bool:
    """True if an exemplar explains a window of the line. mass gives each token's idf, and under "" that of a token seen nowhere."""
    have = set(tokens)
    for i in {i for t in have for i in POSTINGS.get(t, ())}:
        exemplar = BANK[i]
        if exemplar.width < 3 and not exemplar.markup:
            # one or two words are the names of something unless they fill the line
            if have & _STATE_SIGNS:
                continue
            others = sorted((mass[t] for t in tokens if t not in exemplar.tokens), reverse=True)[exemplar.slots :]
            total = sum(others) + sum(mass[t] for t in tokens if t in exemplar.tokens)
            if exemplar.tokens <= have and sum(mass[t] for t in tokens if t in exemplar.tokens) >= FILLED * total:
                return True
            continue
        containment, coverage = _best(tokens, exemplar, mass)
        if containment >= CONTAINMENT and coverage >= COVERAGE:
            return True
    if sum(map(is_filler, tokens)) >= 3:
        for start in range(max(1, len(tokens) - FILLER_WINDOW + 1)):
            part = tokens[start : start + FILLER_WINDOW]
            told = [mass[t] for t in part if is_filler(t)]
            if len(part) >= 4 and len(told) >= 3 and sum(told) >= COVERAGE * sum(mass[t] for t in part):
                return True
    return False


_SCAN = "kind string, row_id long, field string, text string, n long"


def _scan(fields: list[str]):
    """Texts to the windows that retrieve something, and partial document frequencies."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[str]] = {}
        sizes: dict[str, Counter[str]] = {}
        for batch in batches:
            rows: list[tuple] = []
            frequency: Counter[str] = Counter()
            if len(known) > 50_000:
                known.clear()
                sizes.clear()
            for field in fields:
                for row_id, value in zip(batch["row_id"], batch[field]):
                    if value is None:
                        continue
                    for text in (value,) if isinstance(value, str) else value:
                        if not text:
                            continue
                        if text not in known:
                            lines = text.split("\n")
                            tokens = [line_tokens(line) for line in lines]
                            known[text] = [line for line, t in zip(lines, tokens) if t and retrieves(t)]
                            sizes[text] = Counter({"\n": len(lines)})
                            for t in tokens:
                                sizes[text].update(set(t))
                        frequency.update(sizes[text])
                        for window in known[text]:
                            rows.append(("window", row_id, field, window, 1))
            rows += [("df", None, None, token, n) for token, n in frequency.items()]
            if rows:
                kind, ids, names, texts, n = zip(*rows)
                # a list of integers and None must not pass through floats
                yield pd.DataFrame({"kind": kind, "row_id": pd.array(ids, dtype="Int64"), "field": names, "text": texts, "n": pd.array(n, dtype="Int64")})

    return run


def scan_texts(df: DataFrame, row_id: str, fields: dict[str, Column], table: str) -> DataFrame:
    """First pass over one table: ``fields`` maps a field's name to a text or an array of texts."""
    texts = df.where(F.col(row_id).isNotNull()).select(F.col(row_id).cast("long").alias("row_id"), *[c.alias(name) for name, c in fields.items()])
    return texts.mapInPandas(_scan(list(fields)), _SCAN).withColumn("table_name", F.lit(table))


def residue_cases(scans: list[DataFrame]) -> DataFrame:
    """(table_name, row_id, field) of the cases of all scanned tables; idf is that of all of them together."""
    scanned = scans[0]
    for other in scans[1:]:
        scanned = scanned.unionByName(other)
    scanned = cut(scanned, "residue")
    counts = scanned.where("kind = 'df'").groupBy(F.col("text").alias("token")).agg(F.sum("n").alias("n"))
    # at most one row for each token of the exemplars
    fixed = {r["token"]: r["n"] for r in counts.where(F.col("token").isin("\n", *POSTINGS)).collect()}
    total = fixed.pop("\n", 0)

    def idf_of(tokens: dict[str, int]) -> dict[str, float]:
        return {token: math.log((total + 1) / (n + 1)) for token, n in tokens.items()}

    idf = idf_of(fixed) | {"": math.log(total + 1)}

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def other_words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(set(line_tokens(t)) - POSTINGS.keys()))

    @F.pandas_udf(T.BooleanType())
    def is_residue(texts: pd.Series, tokens: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([covered(line_tokens(t), defaultdict(lambda: idf[""], idf | idf_of(dict(zip(k, v))))) for t, k, v in zip(texts, tokens, n)], dtype=bool)

    found = scanned.where("kind = 'window'").select("table_name", "row_id", "field", "text")
    # a window without other words keeps its row
    words = found.select("text").distinct().select("text", F.explode_outer(other_words("text")).alias("token"))
    pairs = F.collect_list(F.when(F.col("n").isNotNull(), F.struct("token", "n")))
    judged = words.join(counts, "token", "left").groupBy("text").agg(pairs.alias("w")).where(is_residue("text", F.col("w.token"), F.col("w.n")))
    return found.join(judged, "text", "left_semi").select("table_name", "row_id", "field").distinct()
