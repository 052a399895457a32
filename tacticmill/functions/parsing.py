"""Parsers that carry state along a text (bracket depth, strings, indentation); Arrow-batched."""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "([{", ")]}"
PAIR = dict(zip(OPEN, CLOSE))


def depth_marks(s: str, strings: bool = True):
    """(index, character, depth after it) outside string literals."""
    depth, quoted = 0, False
    for i, c in enumerate(s):
        if strings and c == '"' and (i == 0 or s[i - 1] != "\\"):
            quoted = not quoted
            continue
        if quoted:
            continue
        depth += (c in OPEN) - (c in CLOSE)
        yield i, c, depth


def split_arguments(s: str | None) -> list[str]:
    """Items separated by blanks or commas outside brackets."""
    cuts = [-1, *[i for i, c, d in depth_marks(s or "", strings=False) if d <= 0 and (c == "," or c.isspace())], len(s or "")]
    return [p for a, b in zip(cuts, cuts[1:]) if (p := (s or "")[a + 1 : b].strip())]


def balanced_prefix(s: str | None, limit: int = 600) -> str:
    """Up to where the first bracket group closes; an open group past the limit is cut at its last outer comma and closed."""
    s = s or ""
    seen, comma, stack = False, -1, []
    for i, c, d in depth_marks(s):
        if c in OPEN:
            seen, _ = True, stack.append(c)
        elif c in CLOSE:
            if stack:
                stack.pop()
            if d == 0 and seen:
                return s[: i + 1].strip()
        elif c == "," and d == 1:
            comma = i
        if i >= limit and d > 0:
            return (s[:comma].rstrip() + "".join(PAIR[b] for b in reversed(stack))).strip() if comma > 0 else s.strip()
    return s.strip()


# Fixed value: the tactics whose bracketed lists are shortened.
_LISTED = re.compile(r"(\b(?:rw|erw|simp|simp_rw|norm_cast|push_cast|pull_cast)\s*)\[([^\]]*)\]")


def without_runs(s: str) -> str:
    """Bracketed lists of rewriting tactics with at most two equal items in a row."""

    def shorter(m: re.Match) -> str:
        items = [p.strip() for p in m.group(2).split(",") if p.strip()]
        kept = [x for i, x in enumerate(items) if not (i > 1 and x == items[i - 1] == items[i - 2])]
        return f"{m.group(1)}[{', '.join(kept)}]"

    return _LISTED.sub(shorter, s)


def clean_tactic(s: str | None) -> str:
    """One line without fences, runs and a comment at its end; empty for giving up."""
    bare = re.sub(r"\s*```\s*$", "", re.sub(r"^```(?:lean4?)?\s*", "", s or ""))
    line = " ".join(p for p in map(str.strip, bare.split("\n")) if p)
    out = re.sub(r"\s+--\s+.*$", "", without_runs(balanced_prefix(line))).strip()
    return "" if out.lower() in ("sorry", "admit") else out


class Output(NamedTuple):
    thought: str
    tactic: str


# The layouts of a model's answer in order of priority.
LAYOUTS = [
    re.compile(r"\[Thought\]\s*(?P<thought>.*?)\s*\[Tactic\]\s*(?P<tactic>.*)", re.S),
    re.compile(r"(?P<thought>)\[Tactic\]\s*(?P<tactic>.*)", re.S),
    re.compile(r"(?P<thought>)\[Error Tactic\]\s*(?!(?:sorry|admit)\b)(?P<tactic>[^;\n]+)", re.I),
    re.compile(r"(?:Thought|Reasoning)\s*:\s*(?P<thought>.*?)\s*(?:Tactic|Action)\s*:\s*(?P<tactic>.*)", re.S | re.I),
    re.compile(r"#{1,3}\s*(?:Thought|Reasoning)\s*\n(?P<thought>.*?)#{1,3}\s*(?:Tactic|Action)\s*\n(?P<tactic>.*)", re.S | re.I),
    re.compile(r"(?:<thought>(?P<thought>.*?)</thought>.*?)?<tactic>(?P<tactic>.*?)</tactic>", re.S | re.I),
]
LABEL = re.compile(r"^\[?(Thought|Tactic|Reasoning|Action|Error Tactic|Error Message)\]?\s*:?\s*$", re.I)


def parse_output(s: str | None) -> Output:
    """Thought and tactic of an answer; without any layout the first line that is no label is the tactic."""
    if not s or not s.strip():
        return Output("", "")
    for layout in LAYOUTS:
        if m := layout.search(s):
            return Output((m.group("thought") or "").strip(), clean_tactic(m.group("tactic").strip()))
    for line in map(str.strip, s.split("\n")):
        line = line.removeprefix(":").strip()
        if line and not LABEL.match(line):
            return Output("", clean_tactic(line))
    return Output("", "")


def tactic_blocks(s: str | None) -> list[str]:
    """A block cut at its unindented lines and at bullets; indented lines belong to the block before."""
    s = s or ""
    blocks: list[list[str]] = []
    for line in s.split("\n"):
        head = line.rstrip()
        if not head:
            if blocks:
                blocks[-1].append(line)
        elif not blocks or not line[0].isspace() or head.startswith("·"):
            blocks.append([line])
        else:
            blocks[-1].append(line)
    return [b for b in ("\n".join(x).rstrip() for x in blocks) if b] or [s]


def goals(s: str | None) -> list[str]:
    """The goals of a state, each up to the next hypothesis block; a text without turnstile is one goal."""
    s = s or ""
    if not s.strip() or s.strip().lower() == "no goals":
        return []
    out = []
    for part in s.split("⊢")[1:]:
        lines: list[str] = []
        for line in part.strip().split("\n"):
            if lines and ":" in line:
                break
            lines.append(line)
        if goal := "\n".join(lines).strip():
            out.append(goal)
    return out or [s.strip()]


def type_expression(statement: str | None) -> str:
    """The type a theorem states: binders before the outer colon become a leading quantifier; the proof is cut off."""
    s = re.sub(r"^\s*(?:theorem|lemma|example|def)\s+\S*\s*", "", statement or "").strip()
    colon = end = None
    for i, c, d in depth_marks(s):
        if d == 0 and c == ":":
            if s[i : i + 2] == ":=":
                end = i
                break
            if colon is None:
                colon = i
    body = s[:end].rstrip()
    if colon is None:
        return body
    binders, kind = body[:colon].strip(), body[colon + 1 :].strip()
    return f"∀ {binders}, {kind}" if binders else kind


def proof_mode(s: str | None) -> str:
    """empty, tactic, term or mixed, by how the proof begins and whether ``by`` occurs inside."""
    body = (s or "").strip()
    if not body:
        return "empty"
    if re.match(r"by\b", body):
        return "tactic"
    return "mixed" if re.search(r"\bby\b", body) else "term"


def tactic_lines(s: str | None) -> list[str]:
    """Single tactics of a proof body: lines and semicolon parts without comments and bullets; combinators stay whole."""
    out = []
    for line in re.sub(r"/-.*?-/", "", re.sub(r"^\s*by\b", "", s or ""), flags=re.S).split("\n"):
        line = re.sub(r"--.*$", "", line).strip().lstrip("·").strip()
        parts = [line] if "<;>" in line else line.split(";")
        out += [p for p in map(str.strip, parts) if p]
    return out


def theorem_blocks(s: str | None) -> list[str]:
    """Declarations of a source text: each from its keyword to the next declaration or blank line outside a proof."""
    starts = [m.start() for m in re.finditer(r"(?m)^(?:@\[[^\]\n]*\]\s*)?(?:private |protected |noncomputable )*(?:theorem|lemma)\s", s or "")]
    ends = [*starts[1:], len(s or "")]
    return [re.split(r"\n\s*\n(?=\S)", (s or "")[a:b])[0].rstrip() for a, b in zip(starts, ends)]


class Range(NamedTuple):
    name: str
    start: int
    end: int


def namespaces(s: str | None) -> list[Range]:
    """Namespaces of a source text with their first and last line from 1, in the order in which they close; unclosed ones drop out.

    A named ``end`` closes the innermost open namespace.
    """
    opened: list[tuple[str, int]] = []
    out = []
    for n, line in enumerate((s or "").split("\n"), 1):
        words = line.split()
        if len(words) < 2:
            continue
        if words[0] == "namespace":
            opened.append((words[1], n))
        elif words[0] == "end" and opened:
            name, start = opened.pop()
            out.append(Range(name, start, n))
    return out


def namespace_at(ranges: list[Range], line: int) -> str:
    """The innermost namespace around a line, or an empty name."""
    return next((r.name for r in ranges if r.start <= line <= r.end), "")


_TEXTS = T.ArrayType(T.StringType())


def _text_function(f):
    @F.pandas_udf(T.StringType())
    def column(x: pd.Series) -> pd.Series:
        return x.map(f, na_action=None).astype(object)

    return column


def _list_function(f):
    @F.pandas_udf(_TEXTS)
    def column(x: pd.Series) -> pd.Series:
        return pd.Series([f(v) for v in x], dtype=object)

    return column


balanced_prefix_column, clean_tactic_column, type_expression_column, proof_mode_column = map(_text_function, (balanced_prefix, clean_tactic, type_expression, proof_mode))
split_arguments_column, tactic_blocks_column, goals_column, tactic_lines_column, theorem_blocks_column = map(_list_function, (split_arguments, tactic_blocks, goals, tactic_lines, theorem_blocks))

OUTPUT = T.StructType([T.StructField("thought", T.StringType()), T.StructField("tactic", T.StringType())])


@F.pandas_udf(OUTPUT)
def _outputs(x: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_output(v) for v in x], columns=["thought", "tactic"])


def parse_output_column(x: Column) -> Column:
    return _outputs(x)


@F.pandas_udf(T.ArrayType(T.StructType().add("name", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType())))
def namespaces_column(x: pd.Series) -> pd.Series:
    return x.map(lambda s: [r._asdict() for r in namespaces(s)], na_action=None).astype(object)
