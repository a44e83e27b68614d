import math
import random

import pytest
from pyspark.sql import functions as F

from folio.llm import mixture


def test_entropy_is_met():
    shares = [0.6, 0.3, 0.08, 0.02]
    for target in (0.2, 0.9, 1.2, math.log(4)):
        weights, _ = mixture.entropy_weights(shares, target)
        assert abs(mixture.entropy(weights) - target) < 1e-6 and abs(sum(weights) - 1) < 1e-9


def test_targets_are_met_where_they_can_be():
    weights, exponent = mixture.target_weights([100, 50, 2, 0], [0.3, 0.3, 0.3, 0.1], [1, 2, 4, 3], 100)
    assert weights[3] == 0 and abs(weights[2] - 0.08) < 1e-9 and abs(sum(weights) - 1) < 1e-9
    assert weights[0] > 0.3 and weights[1] > 0.3 and exponent is not None
    assert mixture.target_weights([10, 10], [0.5, 0.5], [1, 1], 100)[0] == pytest.approx([0.1, 0.1])
    assert mixture.target_weights([10, 30], [0.5, 0.5], [5, 1], 40) == ([0.5, 0.5], None)


def test_what_is_left_open_is_mixed_by_one_exponent():
    """The exponent is bisected to the targets' entropy; the sum of errors is the least there is, and the
    weights are not those of capping and rescaling."""
    rng = random.Random(9)
    changed = met = 0
    for _ in range(200):
        n = rng.randrange(3, 8)
        sizes = [rng.randrange(1, 1000) for _ in range(n)]
        targets = [rng.random() for _ in range(n)]
        repeats = [rng.randrange(1, 5) for _ in range(n)]
        total = sum(sizes)
        weights, e = mixture.target_weights(sizes, targets, repeats, total)
        goal = [t / sum(targets) for t in targets]
        limit = [s * r / total for s, r in zip(sizes, repeats)]
        assert all(w <= m + 1e-9 for w, m in zip(weights, limit)) and abs(sum(weights) - min(1, sum(limit))) < 1e-9
        short = sum(max(0, g - m) for g, m in zip(goal, limit))
        assert abs(sum(abs(w - g) for w, g in zip(weights, goal)) - 2 * short) < 1e-9 and all(w >= min(g, m) - 1e-12 for w, g, m in zip(weights, goal, limit))
        if e is not None:
            ends = [mixture.entropy(mixture._filled([min(g, m) for g, m in zip(goal, limit)], limit, sizes, x)) for x in (0.0, mixture.HOTTEST)]
            if min(ends) < mixture.entropy(goal) < max(ends):
                assert abs(mixture.entropy(weights) - mixture.entropy(goal)) < 1e-6
                met += 1
            open_ = [i for i in range(n) if goal[i] < limit[i]]
            plain = [goal[i] * (1 + short / sum(goal[k] for k in open_)) for i in open_]
            changed += any(abs(weights[i] - p) > 0.01 for i, p in zip(open_, plain))
    assert changed > 50 and met > 5


def _tables(spark, n=600):
    rng = random.Random(2)
    sources = ["big"] * 6 + ["Mid ", "mid", " SMALL", "other", None]
    rows = [(i, "word " * rng.randrange(1, 30), rng.choice(sources)) for i in range(n)] + [(n, None, "big"), (n + 1, "", "mid"), (None, "text", "mid")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("uses", F.lit("clash")).withColumn("id", F.lit(1))
    targets = spark.createDataFrame([("big", 0.3, 1), ("MID", 0.3, 3), ("small", 0.3, 2), ("absent", 0.1, 5)], "source string, target_share double, max_repeats int")
    return docs, targets


@pytest.mark.parametrize("block", [16, 1024])
def test_mixture(spark, monkeypatch, block):
    monkeypatch.setattr(mixture, "BLOCK", block)
    docs, targets = _tables(spark)
    mix = mixture.mix_sources(docs, targets)
    shares = {r.source: r for r in mix.shares.collect()}
    rows = mix.documents.collect()
    assert {r.source for r in rows} == {"big", "mid", "small"} and shares["absent"].tokens == 0
    for s, r in shares.items():
        mine = [x for x in rows if x.source == s]
        assert all(1 <= x.uses <= r.max_repeats for x in mine) and len({x.doc_id for x in mine}) == len(mine)
        assert sum(x.uses * x.n_tokens for x in mine) == r.tokens <= r.budget_tokens
        assert r.budget_tokens - r.tokens <= 60
        assert not mine or max(x.uses for x in mine) - min(x.uses for x in mine) <= 1
    assert shares["small"].tokens == 2 * shares["small"].available_tokens and len({r.exponent for r in shares.values()}) == 1
    assert all(shares[s].reached_share > 0.29 for s in ("big", "mid"))
    assert abs(sum(r.reached_share for r in shares.values()) - 1) < 1e-9


def test_empty_tables(spark):
    docs, targets = _tables(spark, 5)
    assert mixture.mix_sources(docs.limit(0), targets).documents.count() == 0
    assert mixture.mix_sources(docs.limit(0), targets).shares.count() == 4
    assert mixture.mix_sources(docs, targets.limit(0)).documents.count() == 0
