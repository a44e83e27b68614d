import random

import pytest
from pyspark.sql import functions as F

from folio.llm import tokens

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(tokens.TOKENIZER)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def _texts():
    rng = random.Random(3)
    letters = "aaabcdeé  \n\t0123=中ไ\"'tsdll​👍🏽"
    some = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(3000)]
    return some + ["<|endoftext|> don't we'll", "a" * 3000, "=" * 5000, " " * 4000 + "x", "\x00\x07\x1b", "ab" * 2000, "  two  spaces  "]


def test_ids_equal_the_public_tokenizer(public):
    texts = _texts()
    assert tokens.TrieEncoder(tokens.read_spec()).encode(texts) == public(texts)


def test_words_in_any_batch_order_give_the_same_ids(public):
    texts = _texts()[:400]
    enc = tokens.TrieEncoder(tokens.read_spec())
    one_by_one = [enc.encode([t])[0] for t in reversed(texts)][::-1]
    assert one_by_one == public(texts)


def test_corpus(spark, public):
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, " \n"), (5, "Hello world"), (5, "Hello world"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("id", F.lit(0))
    got = [(r.doc_id, list(r.ids)) for r in tokens.encode_corpus(df).collect()]
    want = [(i, public([t or ""])[0]) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    counts = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df, ["doc_id"]).collect()}
    assert counts[2] == counts[3] == 0 and counts[1] == 2
    assert tokens.encode_corpus(df.limit(0)).count() == 0
