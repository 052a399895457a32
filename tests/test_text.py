"""Text functions and parsers on tables of cases."""

import random

import pytest
from pyspark.sql import functions as F

from tacticmill.functions import parsing as Y
from tacticmill.functions import text as X
from tacticmill.operators import chains as C

PREMISES = [
    ("exact Nat.succ_le_of_lt h", ["Nat.succ_le_of_lt"]),
    ("apply List.length_append", ["List.length_append"]),
    ("rw [Foo.bar_baz, ← Qux.quux]", ["Foo.bar_baz", "Qux.quux"]),
    ("simp only [Set.mem_iff, h]", ["Set.mem_iff"]),
    ("nlinarith [Real.sq_nonneg (a + b), Mul.pos h₁ h₂]", ["Mul.pos", "Real.sq_nonneg"]),
    ("have h := Eq.symm_of h", ["Eq.symm_of"]),
    ("convert ← Group.one_mul a", ["Group.one_mul"]),
    ("exact h", []),
    ("rw [mul_comm]", []),
    ("exact @Nat.rec_on n", ["Nat.rec_on"]),
    ("omega", []),
    (None, []),
    ("", []),
]


def test_premises(spark):
    df = spark.createDataFrame([(t,) for t, _ in PREMISES], "t string")
    assert [r[0] for r in df.select(X.premises(F.col("t"))).collect()] == [p for _, p in PREMISES]


def test_unicode_identifiers(spark):
    df = spark.createDataFrame([("h₀ Foo.αbar ℕ.succ x✝¹",), (None,), ("",)], "t string")
    got = [set(r[0]) for r in df.select(X.identifiers(F.col("t"))).collect()]
    assert got[0] >= {"h₀", "Foo.αbar"} and got[1] == got[2] == set()


@pytest.mark.parametrize(
    "state, goal",
    [(None, "(empty state)"), ("", "(empty state)"), ("h : p\n⊢ q", "⊢ q"), ("x" * 300, "x" * 150), ("⊢ " + "y" * 300, "⊢ " + "y" * 198 + "..."), ("   ", "(empty state)")],
)
def test_goal_summary(spark, state, goal):
    assert spark.createDataFrame([(state,)], "s string").select(X.goal_summary(F.col("s"))).first()[0] == goal


def test_hypotheses_clause(spark):
    s = "case inl\na : A\nb : B\nc : C\nd : D\ne : " + "E" * 80 + "\n⊢ g"
    got = spark.createDataFrame([(s,), ("⊢ g",), (None,)], "s string").select(X.hypotheses_clause(F.col("s"))).collect()
    assert [r[0] for r in got] == [" (with hypotheses a : A, b : B, c : C, d : D, ... (1 more))", "", ""]


@pytest.mark.parametrize("tactic, like", [("intro x", True), ("intros", True), ("rintro ⟨a, b⟩", True), ("INTRO h", True), ("introduce", False), ("exact h", False), (" intro", True), (None, False)])
def test_intro_like(spark, tactic, like):
    assert spark.createDataFrame([(tactic,)], "s string").select(X.intro_like(F.col("s"))).first()[0] is like


@pytest.mark.parametrize(
    "message, label",
    [("Type mismatch at x", "TYPE_MISMATCH"), ("unknown identifier 'q'", "UNKNOWN_IDENTIFIER"), ("tactic 'rfl' failed", "TACTIC_FAILED"), ("timeout", "TIMEOUT"), ("unexpected token", "PARSE_ERROR"), ("failed to synthesize", "ELABORATION_ERROR"), ("stuck at ?m.12", "METAVAR_UNRESOLVED"), ("odd", "OTHER"), (None, "OTHER")],
)
def test_error_class(spark, message, label):
    assert spark.createDataFrame([(message,)], "s string").select(X.error_class(F.col("s"))).first()[0] == label


def test_filled_keeps_other_braces(spark):
    df = spark.createDataFrame([("{a} and {b} in {x | p}", "1", None)], "t string, a string, b string")
    assert df.select(X.filled(F.col("t"), a=F.col("a"), b=F.col("b"))).first()[0] == "1 and  in {x | p}"


def _kept(heads: list[str]) -> list[int]:
    """The rule in plain Python."""
    n = len(heads)
    if n <= 3:
        return list(range(n))
    keys = sorted({0, n - 1} | {i for i, h in enumerate(heads) if h in X.KEY_TACTICS})
    target = max(n // 3, 3)
    if len(keys) > target:
        keys = sorted({*keys[:: max(len(keys) // target, 1)], 0, n - 1})
    need = target - len(keys)
    if need > 0:
        rest = [i for i in range(n) if i not in keys]
        keys = sorted({*keys, *rest[:: max(len(rest) // need, 1)][:need]})
    return keys


def test_key_indices_on_random_chains(spark):
    rng = random.Random(7)
    chains = [[rng.choice(["omega", "ring", "rw", "have", "exact", "linarith", "tauto"]) for _ in range(n)] for n in [*range(0, 61), *range(1, 61)]]
    df = spark.createDataFrame([(i, [(h + " x", "s", "t") for h in c]) for i, c in enumerate(chains)], "i int, c array<struct<tactic:string,state_before:string,state_after:string>>")
    got = {r["i"]: r["k"] for r in C.with_key_indices(df, "c", "k").collect()}
    assert got == {i: _kept(c) for i, c in enumerate(chains)}


def test_full_chain_stands_in(spark):
    df = spark.createDataFrame([([], ["a", "b"])], "s array<struct<tactic:string,state_before:string,state_after:string>>, t array<string>")
    got = df.select(C.full_chain(F.col("s"), F.col("t"))).first()[0]
    assert [(r.tactic, r.state_before, r.state_after) for r in got] == [("a", "[state_0]", "[state_1]"), ("b", "[state_1]", "[state_2]")]


@pytest.mark.parametrize(
    "text, want",
    [
        ("[Thought] use it\n[Tactic] rw [a, b]", ("use it", "rw [a, b]")),
        ("[Tactic] simp", ("", "simp")),
        ("Thought: t\nTactic: ring", ("t", "ring")),
        ("### Thought\nwhy\n### Tactic\nexact h", ("why", "exact h")),
        ("<thought>x</thought><tactic>omega</tactic>", ("x", "omega")),
        ("\nTactic:\n: lia", ("", "lia")),
        ("sorry", ("", "")),
        ("", ("", "")),
        (None, ("", "")),
    ],
)
def test_parse_output(text, want):
    assert tuple(Y.parse_output(text)) == want


def test_balanced_prefix():
    assert Y.balanced_prefix("rw [a, b] then more") == "rw [a, b]"
    assert Y.balanced_prefix('f ("(" ++ x) y') == 'f ("(" ++ x)'
    assert Y.balanced_prefix("omega") == "omega"
    long = "rw [" + "abc, " * 200
    assert Y.balanced_prefix(long).endswith("]") and len(Y.balanced_prefix(long)) < 610


def test_clean_tactic():
    assert Y.clean_tactic("```lean\nrw [a, a, a, a,\n  b]\n```") == "rw [a, a, b]"
    assert Y.clean_tactic("omega -- done") == "omega"
    assert Y.clean_tactic("admit") == ""


def test_blocks_goals_and_types():
    assert Y.tactic_blocks("classical\nobtain x\n  y\n· z") == ["classical", "obtain x\n  y", "· z"]
    assert Y.goals("h : p\n⊢ a\nb : B\n⊢ c") == ["a", "c"]
    assert Y.goals("no goals") == [] and Y.goals(None) == [] and Y.goals("x = y") == ["x = y"]
    assert Y.type_expression("theorem f (x : ℕ) : x = x := by rfl") == "∀ (x : ℕ), x = x"
    assert Y.type_expression("theorem g : True := trivial") == "True"
    assert [Y.proof_mode(s) for s in ("", "by simp", "Eq.refl _", "foo (by simp)")] == ["empty", "tactic", "term", "mixed"]
    assert Y.tactic_lines("by\n  simp; ring -- c\n  · a <;> b") == ["simp", "ring", "a <;> b"]
    assert Y.split_arguments("f (a b) [c, d], e") == ["f", "(a b)", "[c, d]", "e"]
    assert len(Y.theorem_blocks("import X\n\ntheorem a : T := by\n  simp\n\nlemma b : U := v\n")) == 2


def test_namespaces():
    text = "import A\nnamespace Foo\nnamespace Bar\ntheorem x : True := trivial\nend Bar\nend Foo\nend\nend Extra\nnamespace Open"
    got = Y.namespaces(text)
    assert [tuple(r) for r in got] == [("Bar", 3, 5), ("Foo", 2, 6)] and Y.namespaces(None) == []
    assert [Y.namespace_at(got, n) for n in (1, 2, 4, 6, 9)] == ["", "Foo", "Bar", "Foo", ""]


def test_single_tactics(spark):
    rows = [("simp [a] <;> ring", "simp", True), ("exact h", "exact", False), (" · omega", "· omega", True), ("", "", False), (None, "", False), ("a; b", "a", True), ("first | x ||| y", "first", True)]
    df = spark.createDataFrame(rows, "t string, name string, c boolean").select(X.single_tactic(F.col("t")).alias("g"), "name", "c")
    assert [(r["g"]["name"], r["g"]["combinator"]) for r in df.collect()] == [(n, c) for _, n, c in rows]


def test_routes_agree_with_the_columns(spark):
    messages = ["type mismatch at x", "unknown constant 'a'", "tactic 'rfl' failed", "deterministic TIMEOUT", "failed to synthesize X", "stuck at ?m.12", "odd", "", None]
    for failures in (0, 2, 3):
        df = spark.createDataFrame([(m,) for m in messages], "m string").select(X.error_class(F.col("m")).alias("c"))
        got = [(r["c"], r["route"]) for r in df.select("c", X.repair_route(F.col("c"), F.lit(failures)).alias("route")).collect()]
        assert got == [X.route_of(m, failures) for m in messages]


def test_messages_are_unwrapped(spark):
    df = spark.createDataFrame([("Message(data='goal not closed', pos=1)",), ("plain",), ("data=''",), (None,)], "m string")
    assert [r[0] for r in df.select(X.unwrapped_message(F.col("m"))).collect()] == ["goal not closed", "plain", "data=''", ""]
