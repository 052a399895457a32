import pytest

from tacticmill.llm.disclosure import _apart, personal_items, sanitised
from tacticmill.llm.disclosure_rules import bare, candidates

ITEMS = [
    ("Thanks to Fennulin Larraskeld for the review.", [("name", "Fennulin Larraskeld")]),
    ("I spoke with Ms. OTTOLINE KELVINETHY <braniset+lean AT nordhall DOT invalid> about `A.b`.", [("name", "OTTOLINE KELVINETHY"), ("email", "braniset+lean AT nordhall DOT invalid")]),
    ("As C. Lakemarsh pointed out, the case 4 is missing.", [("name", "C. Lakemarsh")]),
    ("Reported by Morrastrel, Thessaly.", [("name", "Morrastrel, Thessaly")]),
    ("感谢 Noemi Eldergate 的审阅。", [("name", "Noemi Eldergate")]),
    ("cc I. Varga-Lind, please look", [("name", "I. Varga-Lind")]),
    ("reply-to=elspet+lean@nordhall.invalid;list=off", [("email", "elspet+lean@nordhall.invalid")]),
    ("Write to fennimoor58 (at) mail (dot) velden (dot) example.", [("email", "fennimoor58 (at) mail (dot) velden (dot) example")]),
    ("My office line is +44 1632 960293, ext. 4.", [("phone", "+44 1632 960293")]),
    ("Call (212) 555-0197 before the seminar.", [("phone", "(212) 555-0197")]),
    ("Telefonisch unter +49 (0)30 23125-731 erreichbar.", [("phone", "+49 (0)30 23125-731")]),
    ("SSN ZZ 59 70 91 Q El lema", [("id_number", "ZZ 59 70 91 Q")]),
    ("Her national identity number 994572 22657 is on the form.", [("id_number", "994572 22657")]),
    ("Passport no. 560.354.215-99 was pasted in the log.", [("id_number", "560.354.215-99")]),
    ("Office: 250 Upper Tannery Street\nValbreuse 29979\n", [("address", "250 Upper Tannery Street\nValbreuse 29979")]),
    ("Ship to: ul. Kleszczowa 60/21, 09-308 Veldenburg.", [("address", "ul. Kleszczowa 60/21, 09-308 Veldenburg")]),
    ("Lives at 895 bis, rue des Tisserins, 64921 Port Maren since last year.", [("address", "895 bis, rue des Tisserins, 64921 Port Maren")]),
    ("We meet at Am Alten Tor 430, 77243 Larkfield.", [("address", "Am Alten Tor 430, 77243 Larkfield")]),
    ("The Harbor Atlas build and the Sextant Mirror agree on `h@⟨a, b⟩` at 2026-08-20 05:45:10.", []),
    ("See the Velmarq Lectures, vol. 3, pp. 297-1023, table (629) 855-15987.", []),
    ("Seed 3707185952 and toolchain lean4@v4.1.0 reproduce it. [23:32] @user31: trace 2721b9c18d-db9ff599d4", []),
    ("Users often confuse Gradel.join with Torsal.sieve; the Brackwell-Sund lemma keeps them apart.", []),
]


# names in sentences that hold no cue, and a pair of words that is none
CUE_FREE = ["Later we met Noemi Vintermo in the hall.", "Nobody saw Rurik Eldergate there.", "The key of Quastel, Elspet was found.", "The Velmarq Lectures were printed.", "Stone Bridge is closed."]
KINDS = {"number": {"phone", "id_number"}}

# texts that state who and what is meant: titles, mailboxes, labels, codes
EVIDENCE = [
    *[f"Thanks to {n} <{e}@nordhall.invalid> for the review." for n, e in (("Larraskeld, Fennulin", "a"), ("Ottoline Vintermo", "b"), ("Rurik Quastel", "c"), ("Noemi Lakemarsh", "d"))],
    *[f"As {n} <{e}@lemma-post.test> pointed out, the case {i} is missing." for i, (n, e) in enumerate((("Rurik Lakemarsh", "b"), ("Noemi Quastel", "c"), ("Elspet Vintermo", "d")))],
    *[f"Reported by Dr. {n}." for n in ("Thessaly Morrastrel", "Noemi Morrastrel", "Thessaly Vintermo")],
    *[f"感谢 {n} <{e}@nordhall.invalid> 的审阅。" for n, e in (("Noemi Eldergate", "f"), ("Rurik Eldergate", "g"))],
    *[f"cc {n} <{e}@nordhall.invalid>, please look" for n, e in (("I. Varga-Lind", "h"), ("Elspet Varga-Lind", "i"), ("Rurik Varga-Lind", "j"), ("Noemi Varga-Lind", "k"))],
    *[f"Dr. Thessaly Zorn{x} wrote." for x in "abcdefghijkl"], *[f"Mail from Prof. {n}." for n in ("Ottoline Varga-Lind", "Rurik Varga-Lind", "Noemi Lakemarsh", "Elspet Lakemarsh", "Fennulin Quastel", "Elspet Larraskeld")],
    *[f"cc Dr. {n} Varga-Lind, please look" for n in ("Fennulin", "Ottoline", "Rurik", "Noemi", "Elspet", "Thessaly")],
    *["Dr. Ottoline Kelvinethy wrote.", "Ms. Elspet Kelvinethy wrote.", "Tel. (212) 555-0101", "Phone: (415) 555-0142", "mail (dot) velden.example", "to x@mail.velden.example", "SSN S-77/12345"],
]


@pytest.mark.parametrize("text, want", ITEMS)
def test_items_are_candidates_by_form(text, want):
    got = {(k, text[c.start : c.end]) for c in candidates(bare(text)) for k in KINDS.get(c.kind, {c.kind})}
    assert set(want) <= got


@pytest.mark.parametrize(
    "text, stated",
    [
        ("Thanks to Fennulin Larraskeld for the review.", []), ("As C. Lakemarsh pointed out", []), ("Dr. Fennulin Larraskeld asked", ["Fennulin Larraskeld"]), ("As Una Mark <a@b.test> said", ["Una Mark", "a@b.test"]),
        ("Signed-off-by: Morrastrel, Thessaly", ["Morrastrel, Thessaly"]), ("I met Maria Lindqvist in Oslo.", []), ("Call (212) 555-0197 now", []), ("Tel. (212) 555-0197", ["(212) 555-0197"]), ("+44 1632 960293", ["+44 1632 960293"]),
        ("me AT nordhall DOT invalid", []), ("Lindenweg 3, 95755 San Telvo", ["Lindenweg 3, 95755 San Telvo"]), ("3 Lantern Row, Larkfield", []),
    ],
)
def test_only_form_states(text, stated):
    assert sorted(text[c.start : c.end] for c in candidates(text) if c.seed) == sorted(stated)


def test_the_quick_look_for_mail_loses_nothing(sf_dir):
    import duckdb

    from tacticmill.llm import disclosure_rules as R

    texts = [t for (t,) in duckdb.connect().execute(f"SELECT text FROM '{sf_dir}/documents.parquet' WHERE text IS NOT NULL").fetchall()] + [t for t, _ in ITEMS]
    texts += ["a@b.co", "x At y.zz", "me AT mail DOT velden DOT example", "q [AT] w.org", "İ at b.co"]
    for t in map(bare, texts):
        assert R._may_hold_email(t) or not R.EMAIL.search(t)


@pytest.fixture(scope="module")
def table(spark):
    filler = [f"See the Velmarq Lectures, vol. 1, pp. 20-1{i:03}, table ({100 + i}) 727-{1000 + i}." for i in range(40)]
    names = [f"Thanks to Thessaly Morr{x} for the review. SSN S-{i:02}/8545{i % 10}" for i, x in enumerate("abcdefghijklmnopqrst")]
    extra = ["Later Thessaly Morra wrote more.", "Documento n.º S-12/99999 está aquí.", "Ship to: Lindenweg 3, 95755 San Telvo\n", "Ship to: Lindenweg 4, 95755 San Telvo.", "Ship to: Birkenpfad 7, 62012 Ostwalde Then it ends", "Ship to: Birkenpfad 7, 62012 San Telvo Then it ends"]
    texts = [t for _, t in enumerate([*[t for t, _ in ITEMS], *filler, *names, *extra])] + [None, "", " ", "x" * 200_000 + " Thanks to Thessaly Morrb for the review."]
    texts += EVIDENCE + CUE_FREE
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)]
    return texts, spark.createDataFrame([*rows, *rows[:3]], "key long, text string, kind string, start_pos int")


def test_operator(table):
    texts, df = table
    rows = personal_items(df, "key", "text").collect()
    got = {(r["key"], r["kind"], texts[r["key"]][r["start_pos"] : r["end_pos"]]) for r in rows}
    assert len(rows) == len(got)
    for i, (_, want) in enumerate(ITEMS):
        assert {(k, s) for key, k, s in got if key == i} == set(want)
    n = len(ITEMS)
    assert not [g for g in got if n <= g[0] < n + 40]
    at = n + 60
    assert (at, "name", "Thessaly Morra") in got and (at + 1, "id_number", "S-12/99999") in got
    assert (at + 4, "address", "Birkenpfad 7, 62012 Ostwalde") in got and (at + 5, "address", "Birkenpfad 7, 62012 San Telvo") in got
    long = next(i for i, t in enumerate(texts) if t and len(t) > 200_000)
    assert [g for g in got if g[0] == long] == [(long, "name", "Thessaly Morrb")]


def test_the_score_alone_finds_names_without_a_cue(table):
    texts, df = table
    got = {(r["key"], texts[r["key"]][r["start_pos"] : r["end_pos"]]) for r in personal_items(df, "key", "text").where("kind = 'name'").collect()}
    first = len(texts) - len(CUE_FREE)
    want = [{"Noemi Vintermo"}, {"Rurik Eldergate"}, {"Quastel, Elspet"}, set(), set()]
    assert [{s for k, s in got if k == first + i} for i in range(len(CUE_FREE))] == want


def test_of_overlapping_readings_the_heavier_stay(spark):
    rows = [(0, 10, "name", 0, 2.0, 2.0), (5, 20, "name", 0, 3.0, 3.0), (20, 30, "name", 1, 1.0, 1.0), (22, 30, "name", 0, 0.5, 9.0)]
    df = spark.createDataFrame([(1, *r) for r in rows], "doc_id long, start_pos long, end_pos long, as_kind string, stated int, told double, bits double")
    assert sorted((r["start_pos"], r["end_pos"]) for r in _apart(df).collect()) == [(5, 20), (22, 30)]
    many = spark.range(4000).selectExpr("1L as doc_id", "id * 3 as start_pos", "id * 3 + 4 as end_pos", "'name' as as_kind", "0 as stated", "1.0D as told", "1.0D as bits")
    assert _apart(many).count() == 2000


def test_text_stays_readable(table):
    texts, df = table
    once = df.dropDuplicates(["key"])
    items = personal_items(once, "key", "text")
    out = {r["key"]: r["text"] for r in sanitised(once, items, "key", "text").collect()}
    assert out[0] == "Thanks to [NAME] for the review." and out[1] == "I spoke with Ms. [NAME] <[EMAIL]> about `A.b`."
    assert out[14] == "Office: [ADDRESS]\n" and out[texts.index(None)] is None and out[texts.index("")] == "" and len(out) == len(texts)


def test_empty(table):
    assert personal_items(table[1].limit(0), "key", "text").collect() == []


def test_rows_without_a_key_and_large_keys(spark):
    df = spark.createDataFrame([(2**60 + 1, "Dr. Anna Berg wrote to a@b.test"), (None, "Dr. Anna Berg wrote"), (5, None)], "key long, text string").coalesce(1)
    items = personal_items(df, "key", "text")
    assert {(r["key"], r["kind"]) for r in items.collect()} == {(2**60 + 1, "name"), (2**60 + 1, "email")}
    assert {r["key"]: r["text"] for r in sanitised(df, items, "key", "text").collect()} == {2**60 + 1: "Dr. [NAME] wrote to [EMAIL]", None: None, 5: None}
