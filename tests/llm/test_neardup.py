import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import neardup
from folio.llm.components import connected_components
from folio.llm.words import shingle_hashes, word_hashes, words


def _text(rng, n, vocab=4000):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def _edit(rng, text, share):
    w = text.split()
    for _ in range(int(len(w) * share)):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def test_estimate_is_unbiased_and_less_variable_than_minima():
    rng = random.Random(4)
    errors, minima = [], []
    for _ in range(60):
        base = _text(rng, 300)
        other = _edit(rng, base, 0.06)
        sets = [{tuple(words(t)[i : i + 5]) for i in range(len(words(t)) - 4)} for t in (base, other)]
        true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        split = [words(base), words(other)]
        sig = neardup.minmax_signatures(*shingle_hashes(word_hashes(split), np.array([len(s) for s in split]), np.array([5, 5])))
        same = sig[0] == sig[1]
        errors.append(same.mean() - true)
        minima.append(same[::2].mean() - true)
    assert abs(np.mean(errors)) < 0.02
    assert np.std(errors) < np.std(minima)


def test_groups_equal_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for g in range(40):
        base = _text(rng, rng.choice([30, 80, 300]))
        for _ in range(rng.choice([1, 2, 3])):
            rows.append((f"d{len(rows):03d}", _edit(rng, base, rng.choice([0.0, 0.03, 0.05]))))
        s = base.split()
        rows.append((f"d{len(rows):03d}", " ".join(s[len(s) // 2 :] + s[: len(s) // 2])))
    rows += [("n1", None), ("n2", ""), ("n3", " \n "), ("s1", "short one"), ("s2", "Short  one!")]
    df = spark.createDataFrame(rows + rows[:5], "doc_id string, text string").withColumn("group", F.lit("clash"))
    got = {(r.id_a, r.id_b) for r in neardup.duplicate_pairs(neardup.group_near_duplicates(df)).collect()}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    good = [(i, t) for i, t in rows if t and t.strip()]
    for i, (a, x) in enumerate(good):
        for b, y in good[i + 1 :]:
            if neardup.same_work(x, y):
                parent[find(b)] = find(a)
    want = {tuple(sorted((a, b))) for a, _ in good for b, _ in good if a < b and find(a) == find(b)}
    assert got == want and ("s1", "s2") in got


@pytest.mark.parametrize("share", [0.10, 0.13, 0.16])
def test_scattered_edits_are_the_same_work(share):
    rng = random.Random(21)
    alike = strangers = 0
    for _ in range(40):
        base = _text(rng, 400, 900)
        w = base.split()
        for i in rng.sample(range(len(w)), int(len(w) * share)):
            w[i] = f"x{rng.randrange(10**6)}"
        alike += neardup.same_work(base, " ".join(w))
        strangers += neardup.same_work(base, _text(rng, 400, 900))
    assert alike >= 38 and strangers == 0


def test_groups_do_not_need_every_link(spark):
    rows = _revisions(random.Random(14), 80)
    df = spark.createDataFrame(rows + [("other", _text(random.Random(3), 90))], "doc_id string, text string")
    every, few = ({r.id: r for r in neardup.group_near_duplicates(df, count_links=c).collect()} for c in (True, False))
    assert {k: r.group for k, r in every.items()} == {k: r.group for k, r in few.items()}
    assert sum(r.links for r in few.values()) <= sum(r.links for r in every.values())


def test_large_bucket_of_near_copies_and_strangers(spark):
    rng = random.Random(9)
    base = _text(rng, 60)
    rows = [(f"c{i:03d}", _edit(rng, base, 0.02)) for i in range(300)] + [("copy", base)] * 30 + [(f"k{i}", base) for i in range(20)]
    rows += [(f"z{i:03d}", _text(rng, 60)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.id: r.group for r in neardup.group_near_duplicates(df).collect()}
    assert len({v for k, v in got.items() if k[0] in "ck"}) == 1
    assert len({v for k, v in got.items() if k[0] == "z"}) == 30


def test_pivot_rounds_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 2)
    monkeypatch.setattr(neardup, "PIVOTS", 1)
    rng = random.Random(5)
    stock = _text(rng, 40)
    rows = []
    for g in range(8):
        own = _text(rng, 50)
        rows += [(f"{g}-{i}", stock + " " + _edit(rng, own, 0.02)) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = Counter(r.group for r in neardup.group_near_duplicates(df).collect())
    assert sorted(got.values()) == [3] * 8


def _revisions(rng, n):
    """A short text, texts that extend it each in its own way, and a chain of revisions of the first."""
    stock = _text(rng, 100, 10**6)
    rows = [("hub", stock)] + [(f"r{i:03d}", stock + " " + _text(rng, 40, 10**6)) for i in range(n)]
    chain = rows[1][1]
    for i in range(n // 10):
        w = chain.split()
        at = 100 + 8 * (i % 5)
        chain = " ".join(w[:at] + _text(rng, 8, 10**6).split() + w[at + 8 :])
        rows.append((f"s{i:03d}", chain))
    return rows


def test_large_bucket_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 2)
    monkeypatch.setattr(neardup, "PIVOTS", 1)
    monkeypatch.setattr(neardup, "BLOCK", 8, raising=False)
    rows = _revisions(random.Random(12), 60)
    want = Counter()
    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            if neardup.same_work(x, y):
                want.update((a, b))
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = neardup.group_near_duplicates(df).collect()
    assert {r.id: r.links for r in got} == want and len({r.group for r in got}) == 1


def test_more_than_256_revisions_of_one_text(spark):
    rows = _revisions(random.Random(13), 300)
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.id: r for r in neardup.group_near_duplicates(df).collect()}
    assert len({r.group for r in got.values()}) == 1 and got["hub"].links == len(rows) - 1


def test_empty_table_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id string, text string")
    assert neardup.group_near_duplicates(df).count() == 0
    df = spark.createDataFrame([(None, "a text of some words"), ("a", "a text of some words"), ("b", "A text of some words.")], "doc_id string, text string")
    got = neardup.group_near_duplicates(df).collect()
    assert {r.id for r in got} == {"a", "b"} and len({r.group for r in got}) == 1 and got[0].copies == 2


def test_very_long_text(spark):
    long = "word " * 50_000
    df = spark.createDataFrame([("a", long), ("b", long + "more"), ("c", "=" * 100_000)], "doc_id string, text string")
    assert {r.id: r.copies for r in neardup.group_near_duplicates(df).collect()} == {"a": 1, "b": 1}


@pytest.mark.parametrize("edges,want", [
    ([], {}),
    ([(1, 2), (2, 3), (5, 4), (4, 5), (7, 7), (None, 3)], {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}),
    ([(i, i + 1) for i in range(60)], {i: 0 for i in range(61)}),
    ([(0, i) for i in range(1, 300)], {i: 0 for i in range(300)}),
])
def test_components(spark, edges, want):
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in connected_components(df).collect()} == want
