import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tacticmill.llm.residue import covered, line_tokens, residue_cases, scan_texts

STATE = "G : Type u_2\ninst✝ : ValuonField G\np b : G\nhn : ∃ w ∈ Quandor.span d, Spectron.fac w ≠ Quotien.sect 354\n⊢ ∀ z, Orbitar.join z ∣ Filtrum.frame (z + 304)"
RESIDUE = [
    "{{ footer }}", "{hypotheses_clause}", "⊢ ${target}", "h : {{type}}", "⊢ <goal goes here>", "[state_3]", "[STATE 7]", "state_0_placeholder", "⊢ [TBD]", "%HYP%", "<%= goal %>", "@@STATE@@", "__GOAL__", "[[goal]]", "{0} : {1}",
    "Please enable scripts to load the remaining goals.", "Internal server error at worker 1481; nothing to display", "503 Service Unavailable", "Too many requests. Retry in 82 seconds.", "asdf asdf 7615", "Loading Orbitar…", "blah blah Unitor", "undefined", "TBD",
    "<html><head><title>502 Bad Gateway</title></head><body></body></html>", '{"error": {"code": 408, "detail": "quota for Braidal used up"}}', "Vorem turpe siten siten porta porta.", "-- to be written --", "TODO: fill in later", "xxxxxxxxxx", "NaN",
]
STATES = [
    "", None, "no goals", "No goals.", "goals accomplished", "all goals closed", STATE, STATE.replace("⊢", "|-").replace("∀", "forall"),
    STATE + "\nerror : Except ValuonField V", "todo script : List (Html.Node G)\n⊢ a = b", 'hfmt : Printer.fmt "{}" N₀ = Kernex.leaf ν\n⊢ a = b', "state_1 : Unitor.deg b\n⊢ a = b", "h : x ∈ {a}\n⊢ {z | Filtrum.deg z < 3} ⊆ S",
    "undefined : Junctive K\n⊢ a = b", "loading : Nat\n⊢ loading < 3", 'h : s = "{name}"\n⊢ s = s',
]


def _mass(texts):
    n, df = 0, Counter()
    for t in texts:
        for line in (t or "").split("\n"):
            n += 1
            df.update(set(line_tokens(line)))
    return defaultdict(lambda: math.log(n + 1), {t: math.log((n + 1) / (c + 1)) for t, c in df.items()} | {"": math.log(n + 1)})


def _found(text, mass):
    return any(covered(line_tokens(line), mass) for line in (text or "").split("\n"))


@pytest.mark.parametrize("text", RESIDUE)
def test_residue_is_found_alone_and_inside(text):
    mass = _mass([STATE] * 500 + RESIDUE)
    assert _found(text, mass) and _found(STATE + "\n" + text, mass)


@pytest.mark.parametrize("text", STATES)
def test_states_are_no_residue(text):
    assert not _found(text, _mass([STATE] * 500 + RESIDUE))


NOTICE = "Please enable scripts to load the remaining goals."
OTHERS = "walnut cedar maple orchard river copper lantern garden winter island saddle violin harvest meadow thunder anchor".split()


@pytest.mark.parametrize("before, after", [(0, 10), (10, 0), (9, 9), (16, 16), (0, 200), (200, 200)])
def test_a_notice_inside_a_long_line_is_found(before, after):
    words = OTHERS * 20
    line = " ".join([*words[:before], NOTICE, *words[:after]])
    assert _found(line, _mass([STATE] * 500 + RESIDUE)) and not _found(" ".join(words), _mass([STATE] * 500))


HELD_OUT = [
    "JavaScript is disabled in this browser.", "You must enable scripts: please enable scripts first", "502 Bad Gateway", "Error 403: see the help page", "Connection timed out after 30 s", "Your comment goes here", "Sed nisi lacus quis dolor amet vestibulum.",
    "{% {{user.name}} %}", "Too many requests from your address", "[todo]", "Page not found", "Session 77 has expired",
]


@pytest.mark.parametrize("text", HELD_OUT)
def test_residue_in_other_words_is_found(text):
    assert _found(text, _mass([STATE] * 500 + RESIDUE))


def test_frequencies_decide():
    mass = _mass([STATE] * 500 + RESIDUE)
    flat = defaultdict(lambda: 1.0)
    assert [t for t in RESIDUE if _found(t, mass)] == RESIDUE
    lost = [t for t in RESIDUE if not _found(t, flat)]
    assert "h : {{type}}" in lost and len(lost) >= 3
    # where a shape belongs to the texts' own notation it weighs little next to what else stands there
    own = _mass(["fmt {{x}} orchard"] * 900 + ["fmt {{x}} lantern"])
    assert not _found("fmt {{x}} lantern", own) and _found("{{x}}", _mass([STATE] * 500))


def test_operator(spark):
    rows = [(i, [STATE, r], STATE, i) for i, r in enumerate(RESIDUE)] + [(100 + i, [STATE], s, i) for i, s in enumerate(STATES)] + [(200, None, "[state_0]", 0), (200, None, "[state_0]", 1), (201, [], None, 0), (202, [None, "TBD"], "x " * 100_000 + "{{ goal }}", 0)]
    df = spark.createDataFrame(rows, "key long, chain array<string>, state string, row_id int")
    cases = residue_cases([scan_texts(df, "key", {"chain": F.col("chain"), "state": F.col("state")}, "t")]).collect()
    got = {(r["table_name"], r["row_id"], r["field"]) for r in cases}
    assert len(got) == len(cases)
    assert got == {("t", i, "chain") for i in range(len(RESIDUE))} | {("t", 200, "state"), ("t", 202, "chain"), ("t", 202, "state")}
    assert residue_cases([scan_texts(df.limit(0), "key", {"state": F.col("state")}, "t")]).collect() == []


def test_rows_without_an_id_and_large_ids(spark):
    df = spark.createDataFrame([(2**60 + 1, "TBD"), (None, "TBD"), (5, None)], "key long, s string").coalesce(1)
    assert [r["row_id"] for r in residue_cases([scan_texts(df, "key", {"s": F.col("s")}, "t")]).collect()] == [2**60 + 1]
