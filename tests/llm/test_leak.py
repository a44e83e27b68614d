import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.llm import leak

Q = "Which stopping rule governs the atlas registration inside Rianiformer given that only 178 of the PlefuMix runs converged overnight"


def _distances(item, text):
    row = list(range(len(item) + 1))
    out = []
    for w in text:
        new = [0]
        for i, q in enumerate(item):
            new.append(min(row[i] + (q != w), row[i + 1] + 1, new[i] + 1))
        row = new
        out.append(row[-1])
    return out


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=70), st.lists(st.integers(0, 5), max_size=60))
def test_bit_parallel_equals_dynamic_programming(item, text):
    masks = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    assert leak.myers(masks, len(item), text) == _distances(item, text)
    assert leak.kept_in_order(masks, len(item), text) == _lcs(item, text)


@pytest.mark.parametrize("n", range(1, 60))
def test_pieces_are_one_more_than_errors(n):
    cut = leak.pieces(n)
    assert [a for a, _ in cut] == [0, *(b for _, b in cut[:-1])] and cut[-1][1] == n
    assert len(cut) == min(n, leak.budget(n) + 1) and all(b > a for a, b in cut)


def _edited(rng, words, share):
    w = list(words)
    lost = int(len(w) * share)
    for _ in range(lost):
        w[rng.randrange(len(w))] = f"zz{rng.randrange(999)}"
    return " ".join(w)


def test_search_equals_exhaustive_search(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(60)]
    items = [(f"q{i}", " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 8, 20, 70])))) for i in range(30)]
    docs = []
    for i in range(150):
        body = [rng.choice(vocab) for _ in range(40)]
        q = rng.choice(items)[1].split()
        docs.append((f"d{i}", " ".join(body[:20]) + " " + _edited(rng, q, rng.choice([0, 0.2, 0.3, 0.5])) + " " + " ".join(body[20:])))
    want = set()
    for d, t in docs:
        w = leak.item_words(t)
        for q, s in items:
            item = leak.item_words(s)
            n, most = len(item), leak.budget(len(item))
            for end, e in enumerate(_distances(item, w)):
                if e <= most and _lcs(item, w[max(0, end + 1 - n - most) : end + 1]) >= leak.needed(n):
                    want.add((d, q))
                    break
    docs_df = spark.createDataFrame(docs, "doc_id string, text string")
    items_df = spark.createDataFrame(items, "qid string, question string")
    got = {tuple(r) for r in leak.find_leaks(docs_df, items_df).collect()}
    assert got == want and want


CASES = {
    "same": Q, "case": Q.upper(), "spacing": Q.replace(" ", "\n  "), "tags": Q.replace("atlas", "<b>atlas</b>"),
    "wide": Q.replace("178", "１７８"), "cut": " ".join(Q.split()[:14]), "added": Q.replace("atlas", "atlas (sic)"),
    "hidden": Q.replace("stopping", "stop­ping"), "broken": Q.replace("stopping", "stop ping").replace("overnight", "over-\nnight"),
    "long": "lorem ipsum " * 30_000 + Q + " dolor" * 30_000,
}
OTHERS = {"null": None, "empty": "", "blank": " \n", "half": " ".join(Q.split()[:9]), "mixed": " ".join(sorted(Q.split())), "topic": "atlas registration inside Rianiformer"}


def test_cases(spark):
    docs = spark.createDataFrame([*CASES.items(), *OTHERS.items(), ("same", Q), (None, Q)], "doc_id string, text string").withColumn("qid", F.lit("clash"))
    items = spark.createDataFrame([("a", Q), ("b", Q.lower() + "?"), ("c", None), ("d", ""), (None, Q)], "qid string, question string").withColumn("text", F.lit(Q))
    got = sorted((r.id, r.item) for r in leak.find_leaks(docs, items).collect())
    assert got == sorted((d, q) for d in CASES for q in "ab")
    assert leak.find_leaks(docs.limit(0), items).count() == 0
    assert leak.find_leaks(docs, items.limit(0)).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leak, "BLOCK_CELLS", 200)
    monkeypatch.setattr(leak, "PASS_CHARS", 400)
    items = spark.createDataFrame([(f"q{i}", f"{Q} number {i} of many") for i in range(7)], "qid string, question string")
    docs = spark.createDataFrame([("d", Q + " number 1 of many")], "doc_id string, text string")
    assert leak.find_leaks(docs, items).count() == 7


def test_item_of_very_many_words():
    """Places beyond 65,535 words of an item are told apart."""
    words = [f"w{i}" for i in range(70_000)]
    items = leak.Items([("long", " ".join(words)), ("short", "w69990 w69991 w69992 w69993 w69994 w69995")])
    assert {k for _, k in items.search([words[69_980:]])} == {"short"}


def test_blocks_are_bounded(monkeypatch):
    monkeypatch.setattr(leak, "BLOCK_CELLS", 100)
    rows = [(f"q{i}", "one two three four") for i in range(20)] + [("big", "word " * 500)]
    blocks = leak.blocks_of(rows)
    assert [r for b in blocks for r in b] == rows and len(blocks) > 3 and leak.blocks_of([]) == []
