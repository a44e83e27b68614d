import json

from pyspark.sql import functions as F

from folio.operators import build as K
from folio.operators import corpus as C
from folio.session import ship
from folio.sources import io
from folio.sources.fetch import fetch_doi, fetch_ids

DOC = io.DOCUMENT


def _doc(i, text="x" * 300, **more):
    row = {"doc_id": i, "title": f"T {i}", "text": text, "source": "arxiv", "stratum": "rag", "topic": "t", "year": 2020, "authors": ["A B"], "venue": "V", "doi": None, "url": None, "sections": None, "tags": [], "note": None} | more
    return tuple(row.values())


def test_batches_keep_order_and_constants(spark):
    a = spark.createDataFrame([_doc("a")], DOC)
    b = spark.createDataFrame([("b", "text")], "doc_id string, text string")
    rows = {r.doc_id: r for r in K.union_batches([(a, {}), (b, {"stratum": "clinical", "topic": "inbox"})]).collect()}
    assert rows["a"].src_order == 0 and rows["b"].src_order == 1 and rows["b"].stratum == "clinical" and rows["b"].title is None and rows["a"].topic == "t"


def test_overlay_later_group_wins_and_tags_add_up(spark):
    docs = spark.createDataFrame([_doc("a", tags=["x"]), _doc("b")], DOC)
    groups = spark.createDataFrame([("a", 1, "clinical", None, None, ["p"]), ("a", 2, None, "new", None, ["q", None]), (None, 3, "s", "s", "s", None)], "doc_id string, ord int, stratum string, topic string, note string, tags array<string>")
    rows = {r.doc_id: r for r in K.overlay(docs, groups).collect()}
    assert (rows["a"].stratum, rows["a"].topic, rows["a"].tags) == ("clinical", "new", ["p", "q", "x"]) and rows["b"].topic == "t" and rows["b"].tags == []


def test_build_accounts_for_every_record(spark):
    docs = spark.createDataFrame([
        _doc("a", doi="10.1/X"), _doc("b", "y" * 400, doi="https://doi.org/10.1/x"), _doc("c", None, source="crossref", doi="10.1/c"), _doc("d", "short"), _doc("e", "", tags=["pinned"], title="P", authors=None, year=0, venue=None),
        _doc("e", "", tags=["pinned"], title="P"), _doc(None, None, title=None),
    ], DOC).withColumn("action", F.lit("clash"))
    got = {r.doc_id: r for r in K.build_corpus(docs).collect()}
    assert set(got) == {"b", "c", "e"} and got["b"].action == "keep" and got["c"].text.startswith(K.STUB) and "10.1/c" in got["c"].text and "stub" in got["c"].tags
    row = K.account(docs).first()
    assert (row.n_in, row.deduped, row.kept, row.stubs, row.dropped, row.adds_up) == (7, 2, 1, 2, 2, True)
    assert K.build_corpus(docs.limit(0)).count() == 0 and K.account(docs.limit(0)).first().n_in == 0


def test_snapshot_does_not_depend_on_order(spark):
    docs = spark.createDataFrame([_doc("a"), _doc("b"), _doc("c")], DOC)
    first = K.snapshot_hash(docs).first().snapshot_hash
    assert first == K.snapshot_hash(docs.orderBy(F.desc("doc_id")).repartition(3)).first().snapshot_hash and len(first) == 16
    assert first != K.snapshot_hash(docs.where("doc_id <> 'c'")).first().snapshot_hash
    assert io.verify_snapshot(docs, first) == (True, first)
    assert K.manifest(docs, 1, 250, "now").first().n_documents == 3


def test_inline_records_and_summary(spark):
    rows = spark.createDataFrame([("T", " text "), ("U", " "), (None, None), ("", "other")], "title string, text string")
    got = K.inline_records(rows).collect()
    assert {(r.title, r.text, r.source) for r in got} == {("T", "text", "author_supplied"), ("Untitled", "other", "author_supplied")} and all(r.doc_id.startswith("manual:") for r in got)
    docs = spark.createDataFrame([_doc("a", "x" * 10, year=0), _doc("b", None, year=None), _doc("c", "x" * 4, year=1999)], DOC)
    row = K.summarise(docs).first()
    assert (row.n_documents, row.year_min, row.chars, row.approx_tokens, row.median) == (3, 1999, 14, 4, 4)  # 3.5 goes to the even number
    assert K.summarise(docs.limit(0)).first().n_documents == 0


def test_reparse_counts_changes(spark):
    docs = spark.createDataFrame([_doc("a", "Methods: One. Results: Two."), _doc("b", None)], DOC)
    assert {(r.doc_id, r.n_new, r.changed) for r in K.reparse_sections(docs).collect()} == {("a", 2, True), ("b", 0, False)}


def test_long_sentences_are_cut():
    chunks = C.pack_sentences(["word " * 500, "End."], 200, 40, 30)
    assert max(map(len, chunks)) <= 230 and " ".join(chunks).split().count("word") == 500 and C.pack_sentences([], 200) == []
    assert [len(c) for c in C.pack_sentences(["x" * 450], 200, 0, 10)] == [200, 200, 50]


def test_terms_and_cooccurrence_equal_brute_force(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(C, "TERM_CHARS", 4)
    docs = spark.createDataFrame([("a", "Red", "fox AND hen"), ("b", None, "hen"), ("c", "fox", None), ("c", "fox", None), ("d", None, None)], "doc_id string, title string, text string")
    groups = spark.createDataFrame([("q", ["fox", "HEN"]), ("r", ["fox"]), ("s", ["owl"]), ("t", []), ("u", None), ("v", ["fox", None]), ("w", ["ox", "fox"])], "qid string, terms array<string>")
    assert {(r.qid, r.n, r.doc_id) for r in C.cooccurrences(groups, docs).collect()} == {("q", 1, "a"), ("r", 2, "a"), ("w", 2, "a")}
    terms = spark.createDataFrame([("q", "x a"), ("r", "RED"), ("s", ""), ("t", None), ("u", "owl")], "qid string, term string")
    assert {r.qid for r in C.contained(terms, docs).collect()} == {"q", "r", "s"}
    assert C.contained(terms.limit(0), docs).count() == 0 and C.cooccurrences(groups, docs.limit(0)).count() == 0


def test_sources(spark, tmp_path):
    ship(spark)
    plan = io.read_plan(json.dumps({"clinical": {"ad": {"query": "q", "max_docs": 3}, "mci": "r"}}))
    assert [(p["name"], p["source"], p["max_docs"]) for p in plan] == [("ad", "europepmc", 3), ("mci", "europepmc", 20)]
    assert io.plan_table(spark, plan).count() == 2
    (tmp_path / "ids.jsonl").write_text("\n".join(json.dumps({"doc_id": f"arxiv:{i}", "title": "t", "year": 2000 + i}) for i in range(4)))
    (tmp_path / "doi.jsonl").write_text(json.dumps({"doc_id": "doi:1", "doi": "10.1/A"}))
    meta = spark.createDataFrame([("arxiv:1", 0, "rag", "t", None, ["pinned"])], "doc_id string, ord int, stratum string, topic string, note string, tags array<string>")
    assert {(r.doc_id, r.stratum) for r in fetch_ids(spark, ["1", "x:2", "9"], str(tmp_path), meta).collect()} == {("arxiv:1", "rag"), ("arxiv:2", None)}
    assert fetch_doi(spark, "https://doi.org/10.1/a", str(tmp_path)).first().doc_id == "doi:1" and fetch_doi(spark, "10.1/b", str(tmp_path)).count() == 0
    (tmp_path / "box").mkdir()
    (tmp_path / "box" / "a.txt").write_text("hello")
    (tmp_path / "box" / "b.pdf").write_bytes(b"no pdf")
    got = {r.title: (r.text, bool(r.error)) for r in io.read_inbox_files(spark, str(tmp_path / "box")).collect()}
    assert got == {"a.txt": ("hello", False), "b.pdf": (None, True)}
    one = spark.createDataFrame([("a", None, 0.5)], "k string, v string, x double")
    io.write_json(one, str(tmp_path / "j"))
    assert io.read_json(spark, str(tmp_path / "j"), "k string, v string, x double").collect() == one.collect()
    assert io.markdown_table(one) == "| k | v | x |\n| --- | ---: | ---: |\n| a | n/a | 0.5000 |"
    golden = spark.createDataFrame([("q", "Q?", "answer")], "qid string, question string, expected string")
    io.write_jsonl(golden, str(tmp_path / "g"))
    assert io.load_golden(spark, str(tmp_path / "g")).first().gold_doc_ids is None
