import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.llm import pieces

TEXT = st.text(st.sampled_from("aab .,\n。，é́👩‍x！"), max_size=400)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.sampled_from([(40, 0), (40, 10), (90, 15), (7, 3), (2, 1)]))
def test_nothing_is_lost_and_limits_hold(text, sizes):
    limit, overlap = sizes
    cuts = pieces.bisect_text(text, limit, overlap)
    assert "".join(text[core:end] for _, core, end in cuts) == text
    before = 0
    for i, (start, core, end) in enumerate(cuts):
        assert end - start <= limit and core - overlap <= start <= core
        assert start >= before if i else start == 0
        before = core


def test_strongest_boundary_near_the_middle():
    a, b = "one two three. " * 20, "four five six, seven. " * 14
    cuts = pieces.bisect_text(a + "\n\n" + b, 400, 50)
    assert cuts[1][1] == len(a) + 2
    for start, core, _ in cuts[1:]:
        assert (a + "\n\n" + b)[start - 1].isspace() and core - start > 0


def test_clusters_are_kept():
    text = "👩‍⚕️" * 300
    for start, core, _ in pieces.bisect_text(text, 90, 15)[1:]:
        assert text[start] == text[core] == "👩"


def test_items_and_pieces(spark):
    long = "Some words end here. " * 80
    rows = [
        ("a", "text", [(0, "H", long), (1, "I", None), (2, None, "short")]), ("b", long, None), ("c", long, []), ("d", None, None), ("e", "", []),
        ("f", "x" * 5000, None), ("g", "short", None), ("b", long, None), (None, long, None), ("h", "unused", [(0, "H", None)]),
    ]
    df = spark.createDataFrame(rows, "doc_id string, text string, sections array<struct<pos:int,heading:string,body:string>>").withColumn("pos", F.lit("clash")).withColumn("piece", F.lit(9))
    got = pieces.split_oversized(pieces.items_of(df)).collect()
    over = {(r.id, r.pos) for r in got if r.piece == 1}
    assert over == {("a", 0), ("b", -1), ("c", -1), ("f", -1), (None, -1)}
    assert {(r.id, r.pos) for r in got} - over == {("a", 2), ("e", -1), ("g", -1)}
    mine = sorted((r for r in got if r.id == "a" and r.pos == 0), key=lambda r: r.piece)
    assert "".join(r.text[r.core_start - r.start :] for r in mine) == long and all(len(r.text) <= 900 and r.pieces == len(mine) for r in mine)
    assert pieces.split_oversized(pieces.items_of(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        pieces.split_oversized(pieces.items_of(df), 100, 100)


def test_unbroken_run_is_kept_whole_where_a_boundary_stands_outside_the_middle():
    prose, run = "A sentence of some words. " * 9, "0f" * 333
    assert pieces.cut_points(prose + run, 750) == [0, len(prose)]
    assert pieces.cut_points(run + " " + prose, 750) == [0, len(run) + 1]
    cuts = pieces.cut_points("x" * 5000, 750)
    assert cuts[0] == 0 and max(b - a for a, b in zip(cuts, [*cuts[1:], 5000])) <= 750
