import math
import random

import pytest
from pyspark.sql import functions as F

from folio.llm import quality
from folio.session import Scratch

PROSE = ["The readers of the panel saw the scans and kept the notes.", "It was not the first time that the team was late.", "We held the maps for the others, and they were lost.", "By the end of the year the site was closed."]
JUNK = {
    "table": "site | age | dose\n---|---|---\n" + "\n".join(f"S{i} | {i * 3}.2 | NA" for i in range(30)),
    "log": "\n".join(f"2024-08-18T15:31:{i:02d}Z WARN worker-{i} rc={i}" for i in range(20)),
    "names": ", ".join(f"Name{i}ix" for i in range(60)),
    "symbols": "O#*{ 0 >@_l#_@>&{!]111{O01 1l[_%l}[I*#_O@}I!}@O}10_%1% ~I O &}> {" * 5,
    "boiler": "Accept all cookies > Settings > " * 40,
    "list": "\n".join(f"- item {i} of kind" for i in range(25)),
    "dna": "\n".join("ACGTTGCAAC" * 6 for _ in range(12)),
    "json": "{" + ", ".join(f'"k{i}": {i}' for i in range(50)) + "}",
}


def _docs():
    rng = random.Random(4)
    rows = [(i, " ".join(rng.sample(PROSE, rng.randrange(2, 5))), "en") for i in range(150)]
    rows += [(200, "\n".join(PROSE), "xx"), (201, " ".join(PROSE) + "\n\n- one thing\n- two things", None), (202, " ".join(PROSE).lower(), "EN"), (203, PROSE[0][:30], "en")]
    return rows + [(1000 + i, t, "en") for i, t in enumerate(JUNK.values())] + [(300, None, "en"), (301, "", None), (302, " \n\t", "en")]


def test_junk_is_told_from_prose(spark):
    df = spark.createDataFrame(_docs(), "doc_id long, text string, lang string").withColumn("id", F.lit("clash")).withColumn("score", F.lit(1))
    scored = quality.outlier_scores(quality.document_statistics(df))
    assert {r.id for r in quality.not_prose(scored).collect()} == {1000 + i for i in range(len(JUNK))}
    rows = {r.id: r for r in scored.collect()}
    assert len(rows) == len(_docs()) and all(rows[i].score is None and rows[i].n_words is None for i in (300, 301, 302))


def test_junk_of_a_lone_document_and_of_a_junk_majority(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.sample(PROSE, rng.randrange(2, 5))), "en") for i in range(40)]
    junk = [(100 + i, JUNK["list"], "en") for i in range(80)] + [(300, JUNK["table"], "de"), (301, JUNK["log"], "fr")]
    df = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string")
    scored = quality.outlier_scores(quality.document_statistics(df))
    assert {r.id for r in quality.not_prose(scored).collect()} == {r[0] for r in junk}


def _brute_scores(rows):
    names = [x[0] for x in quality.STATISTICS]
    rows = [r for r in rows if r[1] is not None]

    def cell(r, k):
        v = min(r[3 + k], quality.LONGEST if names[k] == "mean_word_length" else 1 - 1e-6)
        return math.floor(v / quality.STATISTICS[k][2] + 1e-9)

    def scores(reference):
        out = {}
        for r in rows:
            total = 0.0
            for k, (_, side, _, weight) in enumerate(quality.STATISTICS):
                beyond = [x[1] == r[1] for x in reference if (cell(x, k) >= cell(r, k) if side == "high" else cell(x, k) <= cell(r, k))]
                everywhere = len(beyond) / len(reference) if reference else 0.0
                own = sum(x[1] == r[1] for x in reference)
                tail = (sum(beyond) + quality.PRIOR * everywhere) / (own + quality.PRIOR)
                total += weight * min(quality.CAP, -math.log(max(tail, 1e-9)))
            out[r[0]] = total
        return out

    first = scores([r for r in rows if r[-1] >= quality.PROSE])
    return scores([r for r in rows if first[r[0]] < quality.SCORE])


@pytest.mark.parametrize("languages", [["en", "de", "de", "de"], ["en"]])
def test_ranks_and_scores_equal_brute_force(spark, languages):
    rng = random.Random(1)
    rows = [(i, rng.choice(languages), 1.0, round(rng.uniform(0, 60), 2), *[round(rng.choice([0.0, 0.0, rng.random() / 5, rng.random()]), 4) for _ in range(6)], round(rng.random(), 2)) for i in range(300)]
    rows += [(998, "fr", 1.0, *[0.3] * 8), (999, None, *[None] * 9)]
    df = spark.createDataFrame(rows, "id long, lang string, " + ", ".join(f"{n} double" for n in quality._NAMES))
    got = {r.id: r.score for r in quality.outlier_scores(df, Scratch(spark)).collect()}
    want = _brute_scores(rows)
    assert len(got) == len(rows) and got[999] is None
    assert all(got[i] == pytest.approx(v, abs=1e-5) for i, v in want.items())


def test_the_score_decides(spark):
    """Words in no order are junk though each of them is common; a prose share alone condemns nothing."""
    rng = random.Random(3)
    words = [w for s in PROSE for w in s.split()]
    rows = [(i, " ".join(rng.sample(PROSE, rng.randrange(2, 5))), "en") for i in range(400)]
    rows += [(1000, " ".join(w for _ in range(60) for w in rng.sample([x for x in words if x[0].isupper() or len(x) > 4], 1)), "en")]
    scored = quality.outlier_scores(quality.document_statistics(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    row = {r.id: r for r in scored.collect()}[1000]
    assert row.stray_stops > 0.025 and row.score >= quality.SCORE
    assert 2 * quality.CAP < quality.SCORE  # the weight of the prose share


def test_statistics_of_known_text():
    n, length, symbols, digits, ends, common, repeated, stray, prose = quality.statistics_of("One two one two.\nab 12 # x!", {"one", "two"})
    assert (n, ends, repeated) == (8.0, 1.0, 0.0) and common == 0.5 and digits == 0.1 and symbols == 0.05


def test_long_and_empty(spark):
    df = spark.createDataFrame([(1, "the end of it. " * 20_000, "en"), (1, "the end of it. " * 20_000, "en"), (2, "x" * 200_000, None)], "doc_id long, text string, lang string")
    assert quality.document_statistics(df).count() == 3
    assert quality.outlier_scores(quality.document_statistics(df.limit(0))).count() == 0


def test_close_values_have_ranks_of_their_own(spark):
    """Values that differ by less than a thousandth, and shares of almost 1 and of 1, are ranked apart."""
    rows = [(i, "en", 9.0, 5.0 + i / 1e5, 0.0, 0.0, 1.0 - i / 1e7, 0.5 + i / 1e4, 0.0, 0.0, 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, lang string, " + ", ".join(f"{n} double" for n in quality._NAMES))
    got = {r.id: r.score for r in quality.outlier_scores(df).collect()}
    # The tails of the three statistics that differ, among all 40; those of all languages are the same here.
    assert all(got[i] == pytest.approx(-2 * math.log((40 - i) / 40) - math.log((i + 1) / 40), abs=1e-5) for i in range(40))


def test_statistics_are_not_rounded():
    assert quality.statistics_of("one two three 1", set())[3] == 1 / 12
