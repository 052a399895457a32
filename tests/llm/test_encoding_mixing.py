import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tacticmill.llm.encoding import DEFAULT_DIR, DEFAULT_VOCABULARY, TreeEncoder, decode, encode_corpus
from tacticmill.llm.mixing import mixture

PATH = os.path.join(os.environ.get("TOKENIZERS", DEFAULT_DIR), DEFAULT_VOCABULARY)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files here")
WHOLE, SMALL = (TreeEncoder(PATH, leaf) for leaf in (1 << 40, 5)) if os.path.exists(PATH) else (None, None)

PARTS = st.sampled_from(["word", " ", "  ", "\n", "\n\n", "'s", "'re", "'", "x'll", "123", "!?", "=" * 9, "⊢ ∀ ε", "中文", "🙂", "\t", " ", "é", "<|endoftext|>", "，", "。", "a1b2", "x_y", "0", "\u2028", "\xa0", "Ж", "한국", "½", "²", "--", "/", "a b", "\x1c", "\r\n"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=40).map("".join))
def test_tree_encoding_is_plain_encoding(text):
    assert SMALL.encode(text).tolist() == WHOLE.encode(text).tolist()
    assert SMALL.decode(SMALL.encode(text)) == text


def test_same_ids_as_the_other_library():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(PATH.replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    for text in ("import X\n\n/-- don't -/ theorem t : ∀ x, x = x := by rfl", "<|endoftext|> a", "  \n  x", "🙂" * 3):
        assert SMALL.encode(text).tolist() == other.encode(text, add_special_tokens=False).ids


def test_long_runs_without_a_certain_boundary():
    for text in ("=" * 30_000, "中" * 20_000, " " * 20_000, "ab" * 20_000, "word " * 20_000):
        e = TreeEncoder(PATH, 1000)
        assert e.encode(text).tolist() == WHOLE.encode(text).tolist()


def test_windows_stay_small_without_blanks():
    import base64
    import random

    for text in ("策略在目标上失败，因为并未出现。" * 4000, base64.b64encode(random.Random(1).randbytes(60_000)).decode()):
        e = TreeEncoder(PATH, 1000)
        sizes = []
        plain = e._plain
        e._plain = lambda part: (sizes.append(len(part)), plain(part))[1]
        assert e.encode(text).tolist() == WHOLE.encode(text).tolist() and max(sizes) <= 1000 and sum(sizes) < 1.2 * len(text)


def test_operator(spark):
    rows = [(1, "a b", "x"), (2, "", "y"), (3, None, None), (1, "a b", "x"), (4, "é" * 50_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = encode_corpus(df, "doc_id", "text", PATH)
    got = {r["doc_id"]: r["ids"] for r in out.collect()}
    assert out.count() == 5 and got[2] == [] and got[3] == [] and got[1] == WHOLE.encode("a b").tolist()
    back = {r["doc_id"]: r["t"] for r in out.select("doc_id", decode(F.col("ids"), PATH).alias("t")).collect()}
    assert back[4] == "é" * 50_000 and back[3] == ""
    assert encode_corpus(df.limit(0), "doc_id", "text", PATH).collect() == []


def test_mixture(spark):
    rows = [(i, f"{s} text number {i} " + "word " * (i % 30), s, "c") for s, lo, n in (("a", 0, 3000), ("b", 3000, 900), ("c", 4000, 40), ("x", 5000, 50)) for i in range(lo, lo + n)]
    rows += [(9000, "", "a", "c"), (9001, None, "a", "c"), (9002, "null source", None, "c"), (9003, rows[0][1], "b", "c"), (9004, rows[0][1], "a", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 4), ("none", 0.1, 5), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mixture(df, targets, "doc_id", "text", "source", PATH)
    chosen, by = mixed.collect(), {r["source"]: r for r in report.collect()}
    cap = {"a": 1, "b": 3, "c": 4}
    used = {}
    text = {r[0]: r[1] for r in rows}
    for r in chosen:
        assert 1 <= r["copies"] <= cap[r["source"]]
        used[text[r["doc_id"]]] = used.get(text[r["doc_id"]], 0) + r["copies"]
    assert max(used.values()) <= 4 and used.get(rows[0][1], 0) <= 1
    assert by["none"]["rate"] is None and by["none"]["tokens"] == 0 and set(by) == {"a", "b", "c", "none"}
    assert all(abs(by[s]["share"] - p / 0.9) < 0.02 for s, p in (("a", 0.5), ("b", 0.3), ("c", 0.1)))
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, chosen))
    empty, none = mixture(df.limit(0), targets, "doc_id", "text", "source", PATH)
    assert empty.collect() == [] and all(r["tokens"] == 0 for r in none.collect())
