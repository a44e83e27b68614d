import pytest
from pyspark.sql import functions as F

from folio.functions import text as X


def _one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first().r


# The truncation mark counts toward the length; markers are listed once, as first seen.
@pytest.mark.parametrize("f,value,want", [
    (X.normalize_whitespace, "one \t two\n\n\n\n\nthree ", "one two\n\nthree"), (X.normalize_whitespace, None, None), (X.normalize_whitespace, "", ""),
    (lambda c: X.truncate(c, 10), "a long title", "a lo [...]"), (lambda c: X.truncate(c, 12), "a long title", "a long title"), (lambda c: F.length(X.truncate(c, 80)), "y" * 300, 80), (lambda c: X.truncate(c, 3), "abcdef", "abc"),
    (X.clean_markup, "<div>Two <i>words</i></div>", "Two words"), (X.clean_markup, "a &lt; b &amp; c<!-- x --><script>y</script>", "a < b & c"), (X.clean_markup, None, None),
    (X.split_sentences, "Dr. Moll read 2.5 maps, i.e. most of them. Is Fig. 7 lost? It is!", ["Dr. Moll read 2.5 maps, i.e. most of them.", "Is Fig. 7 lost?", "It is!"]), (X.split_sentences, "", []), (X.split_sentences, None, None),
    (X.markers, "See [3]. Both [5, 3] hold. None [8,5].", [3, 5, 8]), (X.markers, "none", []),
    (X.tokens, "A two-stage reader", ["a", "two-stage", "two", "stage", "reader"]), (X.tokens, "", []), (X.tokens, None, None),
    (lambda c: X.tokens(c, True), "MCI and CSF", ["mci", "mild", "cognitive", "impairment", "and", "csf", "cerebrospinal", "fluid"]),
    (X.bare_id, "doi:10.1/a:b", "10.1/a:b"), (X.bare_id, "plain", "plain"), (X.bare_id, None, None),
    (lambda c: X.fixed_digits(c.cast("double"), 2), "3.14159", "3.14"), (lambda c: X.percent(c.cast("double")), "0.125", "12.5%"), (lambda c: X.percent(c.cast("double")), None, "n/a"),
])
def test_scalars(spark, f, value, want):
    assert _one(spark, value, f) == want


@pytest.mark.parametrize("text,want", [
    ("Objective: We asked who reads maps. Design: A panel met. Findings: Few do.", [("Objective", "We asked who reads maps."), ("Design", "A panel met."), ("Findings", "Few do.")]),
    ("BackgroundMaps are rarely read.MethodsThe panel met twice.", [("Background", "Maps are rarely read."), ("Methods", "The panel met twice.")]),
    ("Our findings agree, and the design of the results table is new.", [("Abstract", "Our findings agree, and the design of the results table is new.")]),
    ("# First part\n\nOne.\n### Second PART\nTwo.", [("First Part", "One."), ("Second Part", "Two.")]),
    ("", [("Abstract", "")]),
])
def test_sections(spark, text, want):
    assert [(s.heading, s.body) for s in _one(spark, text, X.sections_of)] == want


def test_tags_and_urls(spark):
    rows = [(["b", "a", None], ["a", "c"], "", "10.1/x"), (None, None, None, None), (["z"], None, "http://u", "10.1/x")]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>, url string, doi string")
    got = df.select(X.tag_union(F.col("a"), F.col("b")).alias("t"), X.landing_url(F.col("url"), F.col("doi")).alias("u")).collect()
    assert [tuple(r) for r in got] == [(["a", "b", "c"], "https://doi.org/10.1/x"), ([], None), (["z"], "http://u")]


def test_authors(spark):
    rows = [(["a", "b", "c", "d"],), (["a", None],), ([],), (None,), ([None],)]
    got = [r.x for r in spark.createDataFrame(rows, "a array<string>").select(X.author_list(F.col("a")).alias("x")).collect()]
    assert got == ["a, b, c et al.", "a", "Unknown", "Unknown", "Unknown"]
