import random

import pytest

from tacticmill.llm.pairs import _lcs, defect, foreign, pair_defects

EM = "elaborator stuck: cannot infer Jetspan.lvl from ?m.44436"
SOUND = "The step `simp` fails because Jetspan.lvl is not visible there. Use `omega`, which closes the goal."

CASES = [
    (EM, None, "empty"), (EM, "", "empty"), (EM, " \n\t ", "empty"), (EM, "​", "empty"), (EM, "N/A", "empty"), (EM, "n/a.", "empty"), (EM, "``", "empty"), (EM, "—", "empty"), (EM, "None", "empty"), (EM, "[]", "empty"), (EM, "...", "empty"),
    (EM, EM, "copy"), (EM, f'"{EM}"', "copy"), (EM, EM.upper(), "copy"), (EM, f"Error: {EM}", "copy"), (EM, f"> {EM}", "copy"), (EM, f"The error message is:\n  {EM}", "copy"), (EM, f"{EM} {EM}", "copy"),
    (EM, "I'm sorry, but I can't help with this proof.", "refusal"), (EM, "The step fails. However, I'm not comfortable saying more about it and will leave it there.", "refusal"),
    (EM, "Sorry — I won't be able to assist with Foo.bar.", "refusal"), (EM, "As an automated assistant I am unable to judge Foo.bar.", "refusal"),
    (EM, "Der Schritt `abel` scheitert an dem Ziel, weil Torsal.mix dort nicht vorkommt.", "other_language"), (EM, "策略 `skip` 在目标上失败，因为 Braidal.flow 并未出现。", "other_language"), (EM, "Шаг `omega` не проходит, так как гипотеза не подходит.", "other_language"),
    (EM, "La tactique `decide` échoue sur le but car la conclusion n'y figure pas et il faut une autre voie.", "other_language"),
    (EM, SOUND[:60], "truncated"), (EM, SOUND + " It therefore ret", "truncated"), (EM, SOUND + " This is `exact Foo...`", "truncated"), (EM, SOUND + " So Jetspan.lvl differs from Torsal.", "truncated"),
    (EM, SOUND, None), (EM, f"```text\n{SOUND}\n```", None), (EM, f"{SOUND} ∎", None), (EM, f"{SOUND} “So it is.”", None), (EM, f"{SOUND}\nCorrect step: `omega`", None), (EM, f"{SOUND} (See Foo.bar_baz.)", None),
    (EM, f"A note reads “先化简再代入”, kept as found. {SOUND}", None), (EM, f"The full reply was: \"{EM}\". {SOUND}", None), (None, SOUND, None), ("", SOUND, None), (EM, SOUND.replace("`", "'"), None),
]


@pytest.mark.parametrize("prompt, response, label", CASES)
def test_labels(prompt, response, label):
    assert defect(prompt, response) == label


@pytest.mark.parametrize(
    "prompt, response, label",
    [
        *[(EM, " ".join([EM] * n), "copy") for n in (5, 8, 40)], *[(EM, "none" + "\u200b" * n, "empty") for n in (10, 300)], (EM, "​" * 500, "empty"), (EM, "— " * 300, "empty"),
        # copies with words put in, left out and exchanged
        (EM, EM.replace("cannot infer", "can infer"), "copy"), (EM, EM.replace("elaborator ", "") + ".", "copy"),
        ("the rewrite of the goal by the lemma has failed in the block after the step that was tried", "the rewrite of goal by the lemma has failed in block after the last step that was tried", "copy"),
        # refusals with words put in, left out and in front
        (EM, "This question simply falls outside what I may discuss.", "refusal"), (EM, "Question falls outside what I may answer.", "refusal"), (EM, "I am really not comfortable with this.", "refusal"), (EM, "I really do not feel qualified to judge it.", "refusal"),
        (EM, "It seems not appropriate for me to say more.", "refusal"), (EM, "It is appropriate to refuse `rfl` here.", None),
    ],
)
def test_edited_copies_and_refusals(prompt, response, label):
    assert defect(prompt, response) == label


SENTENCES = {
    "de": "Wir haben gestern lange überlegt und dann einen anderen Weg gewählt, weil dieser kürzer war.",
    "fr": "Nous avons longtemps cherché hier soir et nous avons choisi un autre chemin plus court.",
    "es": "Ayer pensamos mucho tiempo y luego elegimos otro camino porque era más corto que el primero.",
    "it": "Ieri abbiamo pensato a lungo e poi abbiamo scelto un'altra strada perché era più breve.",
    "pl": "Wczoraj długo myśleliśmy i wybraliśmy inną drogę, ponieważ była krótsza od pierwszej.",
    "nl": "Gisteren hebben we lang nagedacht en toen een andere weg gekozen omdat die korter was.",
    "sv": "Igår funderade vi länge och valde sedan en annan väg eftersom den var kortare.",
    "fi": "Eilen mietimme asiaa pitkään ja valitsimme toisen tien, koska se oli lyhyempi.",
    "hu": "Tegnap sokáig gondolkodtunk, aztán egy másik utat választottunk, mert rövidebb volt.",
    "vi": "Hôm qua chúng tôi đã suy nghĩ rất lâu và chọn một con đường khác vì nó ngắn hơn.",
    "ru": "Вчера мы долго думали и выбрали другой путь, потому что он был короче.",
}
ENGLISH = ["Yesterday we thought about it for a long time and then chose another way because it was shorter.", "Rewriting fails since nothing matches; unfold first, then simplify.", "Notice how both sides agree modulo associativity.", "Kindly consult your supervisor regarding inductive hypotheses."]


def test_languages_are_told_by_letters():
    assert [k for k, s in SENTENCES.items() if not foreign(EM, s)] == []
    assert [s for s in ENGLISH if foreign(EM, s)] == []


def test_bits_give_the_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(0, 90))] for _ in "ab")
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert _lcs(a, b) == row[-1]


def test_long_pairs_are_aligned():
    words = [f"w{i % 997}" for i in range(50_000)]
    swapped = [words[i ^ 1] for i in range(50_000)]
    assert defect(" ".join(words), " ".join(swapped)) is not None


def test_very_long_texts_are_read_whole():
    assert defect(EM, SOUND * 20_000) is None
    assert defect(EM, SOUND * 20_000 + " It therefore ret") == "truncated"
    assert defect("x " * 50_000, SOUND) is None


def test_operator(spark):
    rows = [(1, EM, "N/A", 1, "a"), (1, EM, "N/A", 2, "b"), (2, EM, SOUND, 1, "a"), (3, EM, None, 1, None), (4, EM, "N/A", 1, "x"), (4, EM, SOUND, 2, "x"), (None, EM, "", 1, "z")]
    df = spark.createDataFrame(rows, "record_id long, error_message string, reflection string, version int, defect string")
    got = sorted(map(tuple, pair_defects(df, "record_id", "error_message", "reflection", "version").collect()), key=repr)
    assert got == [(1, "empty"), (3, "empty"), (None, "empty")]
    assert pair_defects(df.limit(0), "record_id", "error_message", "reflection").collect() == []
