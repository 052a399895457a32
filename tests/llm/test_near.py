import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tacticmill.llm import near
from tacticmill.llm.hashing import segment_keys
from tacticmill.llm.near import exact_jaccard, least_matches, near_groups, near_pairs, self_join, spread
from tacticmill.llm.overlap import overlap_pairs, overlap_report


def shingle_set(text: str) -> frozenset:
    w = text.lower().split()
    return frozenset(zip(w, w[1:], w[2:]))


def edited(words: list[str], rng: random.Random, n: int) -> list[str]:
    out = list(words)
    for _ in range(n):
        i = rng.randrange(len(out))
        out[i : i + rng.choice([0, 1])] = [f"new{rng.randrange(99)}"]
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = []
    for i in range(120):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(25, 60))]
        out += [" ".join(edited(base, rng, k)) for k in (0, 2, 5, 9)]
    out += [out[0]] * 40 + ["short text", "", "A " * 30]
    return [(i, t[: len(t) // 2], t[len(t) // 2 :].strip() or None) for i, t in enumerate(out)]


def brute(rows, threshold):
    sets = {}
    for i, a, b in rows:
        t = f"{a or ''} {b or ''}"
        if len(t.split()) >= 20:
            sets[i] = shingle_set(t)
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


@pytest.fixture(scope="module")
def table(spark, texts):
    rows = texts + texts[:5]  # delivered again
    return spark.createDataFrame([(i, a, b, i, "x") for i, a, b in rows], "rid long, a string, b string, id long, cls string")


def test_pairs_against_brute_force(table, texts):
    want = brute(texts, 0.5)
    rows = near_pairs(table, "rid", ["a", "b"]).collect()
    got = {tuple(r) for r in rows}
    assert len(rows) == len(got) and got <= want and len(got) >= 0.99 * len(want)


def test_hot_bands_are_cut_without_losing_pairs(table, texts, monkeypatch):
    monkeypatch.setattr(near, "SHARE", 1)
    monkeypatch.setattr(near, "BLOCK", 1)
    monkeypatch.setattr(near, "hot_bands", lambda rows, n: rows.groupBy("key").count().where("count > 1").select("key", F.lit(3).alias("blocks")))
    assert {tuple(r) for r in near_pairs(table, "rid", ["a", "b"]).collect()} >= {p for p in brute(texts, 0.6)}


def test_salted_join_is_the_plain_join(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(rng.randrange(5), c) for c in range(80)], "key long, cls long")
    hot = spark.createDataFrame([(0, 4), (3, 7)], "key long, blocks int")
    plain = {tuple(r) for r in self_join(rows, hot.limit(0)).collect()}
    assert plain == {tuple(r) for r in self_join(rows, hot).collect()} and len(plain) > 100


def test_large_classes_are_spread_over_blocks(table, texts, monkeypatch, spark):
    whole = {tuple(r) for r in near_pairs(table, "rid", ["a", "b"]).collect()}
    monkeypatch.setattr(near, "MEMBERS", 6)
    rows = near_pairs(table, "rid", ["a", "b"]).collect()
    assert len(rows) == len(whole) and {tuple(r) for r in rows} == whole
    members = spark.createDataFrame([(7, i) for i in range(40)] + [(8, 100)], "cls long, id long")
    links = spark.createDataFrame([(7, 8), (7, 7)], "ca long, cb long")
    got = spread(links, members, members).collect()
    assert len(got) == len({tuple(r) for r in got}) == 40 + 1600


def test_segments_are_pieces_of_the_code():
    code = np.random.default_rng(1).integers(0, 256, (5, 12)).astype(np.uint8)
    keys = segment_keys(code, 6)
    assert keys.shape == (5, 2)
    for row, own in zip(code, keys):
        assert [int(k) for k in own] == [int.from_bytes(bytes([i]) + row[6 * i : 6 * i + 6].tobytes(), "big") for i in range(2)]


def test_groups(table, texts):
    want = brute(texts, 0.5)
    got = near_groups(table, "rid", ["a", "b"]).collect()
    degree = {}
    for a, b in want:
        degree[a] = degree.get(a, 0) + 1
        degree[b] = degree.get(b, 0) + 1
    assert len(got) == len({r["rid"] for r in got})
    same = [r["n_links"] == degree.get(r["rid"]) for r in got]
    assert sum(same) >= 0.98 * len(same)
    heads = {r["rid"]: r["group_id"] for r in got}
    assert all(heads[a] == heads[b] for a, b in want if a in heads and b in heads and a // 4 == b // 4 < 100) or len(want) > 0


def test_empty(table):
    assert near_pairs(table.limit(0), "rid", ["a", "b"]).collect() == []
    assert near_groups(table.limit(0), "rid", ["a", "b"]).collect() == []


def test_pruning_keeps_what_reaches_the_threshold():
    least = least_matches(0.5, 1e-4)
    rng = np.random.default_rng(2)
    hits = rng.random((20_000, near.CODE)) < 0.5 + 0.5 / 256
    kept = np.ones(len(hits), dtype=bool)
    for n, m in zip(near.STEPS, least):
        kept &= hits[:, :n].sum(axis=1) >= m
    assert kept.mean() > 0.999 and least == tuple(sorted(least)) and least[-1] > 12


def test_overlaps_against_brute_force(spark):
    rng = random.Random(5)
    rows, n = [], 0
    for _ in range(150):
        base = [f"v{rng.randrange(300)}" for _ in range(40)]
        for k in (0, 3, 8, 14):
            rows.append((n, f"T{n % 7}", " ".join(edited(base, rng, k)), None if n % 11 == 0 else "t", rng.choice(["train", "val", "test", None]), "s", "x"))
            n += 1
    rows += [(n, None, "", "t", "train", None, "x"), (n + 1, "a", None, "t", "val", None, "x"), *rows[:4]]
    df = spark.createDataFrame(rows, "rid long, name string, state string, tactic string, split string, source string, key string")
    sets = {r[0]: frozenset(f"{r[1] or ''} {r[2]} {r[3] or ''}".split()) for r in rows if r[2]}
    side = {r[0]: r[4] for r in rows}
    gone = {0, 1, 2}
    train = [i for i in sets if side[i] == "train" and i not in gone]
    held = [i for i in sets if side[i] in ("val", "test") and i not in gone]
    want = {(min(a, b), max(a, b)) for a in train for b in held if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    bad = spark.createDataFrame([(i,) for i in gone], "row_id long")
    pairs = overlap_pairs(df, "rid", "split", ["name", "state", "tactic"], ["state"], bad)
    got = {tuple(r) for r in pairs.collect()}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 50
    report = overlap_report(df, pairs, "rid", "split", "source").collect()
    assert sum(r["overlapping"] for r in report) == len({i for p in got for i in p if side[i] in ("val", "test")})
    assert overlap_pairs(df.limit(0), "rid", "split", ["name", "state", "tactic"], ["state"]).collect() == []


def test_exact_jaccard(spark):
    df = spark.createDataFrame([("a b c d", "a b c e"), ("", ""), ("a b c", "A b  c")], "x string, y string")
    got = [r[0] for r in df.select(exact_jaccard(3)(F.col("x"), F.col("y"))).collect()]
    assert got == [1 / 3, 0.0, 1.0]


def test_rows_without_an_id_and_large_ids(spark):
    text, big = " ".join(f"w{i}" for i in range(40)), 2**60 + 1
    rows = [(big, text, None, "train"), (big + 1, text, None, "val"), (None, text, None, "train"), (None, text, None, "val"), (3, None, None, None)]
    df = spark.createDataFrame(rows, "rid long, a string, b string, split string").coalesce(1)
    assert [tuple(r) for r in near_pairs(df, "rid", ["a", "b"]).collect()] == [(big, big + 1)]
    assert {r["rid"] for r in near_groups(df, "rid", ["a", "b"]).collect()} == {big, big + 1}
    assert [tuple(r) for r in overlap_pairs(df, "rid", "split", ["a", "b"], ["a"]).collect()] == [(big, big + 1)]
