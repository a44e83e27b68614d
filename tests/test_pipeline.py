import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.config import Config
from folio.operators import citations as A
from folio.operators import evaluation as E
from folio.operators import pipeline as P
from folio.operators import retrieval as R
from folio.session import ship
from folio.sources import io

CHUNK = "chunk_id string, doc_id string, text string, header string, section string, doc_stratum string, doc_year int"
GATE = "signal string, mean double, std double, weight double"


@pytest.fixture()
def chunks(spark):
    ship(spark)
    rows = [(f"c{i}", f"d{i % 4}", f"Readers of group {i} rated the maps of the {w}. They held {i} visits.", f"Title {i}", "Methods" if i % 2 else "Results", "rag" if i < 6 else "clinical", 2000 + i) for i, w in enumerate(["thalamus", "fornix", "cortex", "pons", "retina", "fornix", "insula", "fornix"])]
    return spark.createDataFrame(rows + rows[:1] + [("n", "d9", None, None, None, None, None), (None, "d9", "fornix", None, None, None, None)], CHUNK).withColumn("score", F.lit("clash"))


def _asked(spark):
    return spark.createDataFrame([("q1", "Who rated the fornix?"), ("q2", ""), ("q3", None), ("q4", "xyzzy")], "qid string, question string").withColumn("run_id", F.lit("clash"))


@pytest.mark.parametrize("mode", P.MODES)
def test_modes_cap_and_top(spark, chunks, mode):
    hits = P.retrieve(_asked(spark), chunks, Config(mode=mode, top_k=4, max_chunks_per_doc=1)).collect()
    mine = sorted((h for h in hits if h.query_id == "q1"), key=lambda h: h["rank"])
    assert {h.query_id for h in hits} <= {"q1", "q4"} and [h["rank"] for h in mine] == [1, 2, 3, 4][: len(mine)] and mine
    assert len({h.doc_id for h in mine}) == len(mine) and "fornix" in (mine[0].matched_terms or ["fornix"])
    assert all((h.sparse is None) == (mode == "dense") or mode in ("weighted", "hybrid") for h in mine)


def test_filters_come_before_scoring(spark, chunks):
    found = lambda f: {h.chunk_id for h in P.retrieve(_asked(spark), chunks, Config(top_k=9, max_chunks_per_doc=0), f).collect() if h.query_id == "q1"}
    assert found({"strata": ["no such"]}) == set() and found({"strata": ["clinical"]}) == {"c6", "c7"}
    assert found({"year_min": 2002, "year_max": 2003}) == {"c2", "c3"} and found({"contains": ["FORNIX", "visits"], "sections": ["Methods"]}) == {"c1", "c5", "c7"}
    assert found({}) == found(None) and R.chunk_filter({"strata": [], "other": 3}) is None
    with pytest.raises(ValueError):
        P.retrieve(_asked(spark), chunks, Config(mode="best"))


def test_dense_equals_brute_force(spark, monkeypatch):
    ship(spark)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    x[10] = x[11] = x[12]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(60, None), (61, [0.0] * 8), (62, [1.0]), (0, [float(v) for v in x[0]]), (None, [1.0] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = vectors.where("vec_id in (3, 12, 60, 61)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(q, int(i)) for q in (3, 12) for i in [v for v in np.lexsort((np.arange(60), -np.round(unit @ unit[q], 9))) if v != q][:5]}
    for values in (8_000_000, 8):
        monkeypatch.setattr(R, "QUERY_VALUES", values)
        assert {(r.query_id, r.vec_id) for r in R.dense_topk(queries, vectors, 5).collect()} == want
    assert R.dense_topk(queries.limit(0), vectors, 5).count() == 0 and R.dense_topk(queries, vectors.limit(0), 5).count() == 0


def test_rerank_changes_the_first_only(spark):
    rows = [(0, "q", f"c{i}", i + 1, s) for i, s in enumerate([0.1, None, 0.9, 5.0])]
    hits = spark.createDataFrame(rows, "run_id long, query_id string, chunk_id string, rank int, s double")
    order = lambda df: [r.chunk_id for r in df.orderBy("rank").collect()]
    assert order(R.rerank(hits, F.col("s"), 3)) == ["c2", "c0", "c1", "c3"] and order(R.rerank(hits, F.lit(1.0), 3)) == ["c0", "c1", "c2", "c3"]


def test_ask_gates_answers_and_audits(spark, chunks):
    asked = _asked(spark)
    open_ = {r.qid: r for r in P.ask(asked, chunks).collect()}
    assert set(open_) == {"q1", "q2", "q3", "q4"} and not open_["q1"].refused and open_["q1"].citations[0].quote in [r.text.split(". They")[0] + "." for r in chunks.collect() if r.text]
    assert open_["q1"].fabricated_markers == [] and open_["q1"].citation_coverage == 1.0 and open_["q2"].refusal_reason == "no_support" and open_["q2"].citations == []
    gate = spark.createDataFrame([("top_sparse", 0.0, 1.0, 1.0)], GATE)
    shut = {r.qid: r for r in P.ask(asked, chunks, Config(abstain_threshold=1e6), None, gate).collect()}
    assert all(r.refused and r.refusal_reason == "gate" and r.answer == "INSUFFICIENT_CONTEXT" for r in shut.values())
    never = {r.qid: r for r in P.ask(asked, chunks, Config(abstain_threshold=1e6, abstain=False), None, gate).collect()}
    assert not never["q1"].refused and "qid" in P.answers_json(P.ask(asked, chunks)).first().json


def test_inactive_gate_never_refuses_and_no_hits_refuse(spark):
    signals = spark.createDataFrame([(0, "q", 0.1, 0.1, None, None, 1.0)], "run_id long, query_id string, top_dense double, mean_top3 double, top_sparse double, score_gap double, n_matched double")
    useless = spark.createDataFrame([("top_dense", 0.5, None, 1.0), ("mean_top3", None, 0.1, 1.0)], GATE)
    good = spark.createDataFrame([("top_dense", 0.5, 0.1, 1.0)], GATE)
    keys = spark.createDataFrame([(0, "q"), (0, "none")], "run_id long, query_id string")
    assert not E.gate_is_active(useless) and E.gate_is_active(good)
    quiet = E.decide(E.gate_confidence(signals, useless), 9.0, E.gate_is_active(useless), keys).collect()
    assert len(quiet) == 2 and not any(r.refused for r in quiet)
    assert {r.query_id: r.refused for r in E.decide(E.gate_confidence(signals, good), -9.0, True, keys).collect()} == {"q": False, "none": True}


def test_gate_files(spark, tmp_path):
    gate = spark.createDataFrame([("top_dense", 0.5, 0.1, 1.0)], GATE)
    io.save_gate(str(tmp_path / "g"), gate, -0.3, "lexical")
    rows, threshold = io.load_gate(spark, str(tmp_path / "g"), "lexical")
    assert E.gate_is_active(rows) and threshold == -0.3
    assert not E.gate_is_active(io.load_gate(spark, str(tmp_path / "g"), "other")[0]) and not E.gate_is_active(io.load_gate(spark, str(tmp_path / "g"), "lexical", abstain=False)[0])


def test_saved_index_gives_the_same_hits(spark, chunks, tmp_path):
    plain = chunks.where("chunk_id is not null").dropDuplicates(["chunk_id"])
    text = plain.select("chunk_id", R.index_text(True).alias("text"))
    io.save_index(str(tmp_path / "i"), plain, R.postings(text, expand=True), "lexical", R.encode_lexical(text, "chunk_id", "text", expand=True))
    saved, postings, vectors = io.load_index(spark, str(tmp_path / "i"), "lexical")
    rows = lambda df: sorted((r.query_id, r.chunk_id, r["rank"], round(r.score, 9)) for r in df.collect())
    assert rows(P.retrieve(_asked(spark), saved, postings=postings, vectors=vectors)) == rows(P.retrieve(_asked(spark), plain))


def test_quotes_and_references(spark):
    answers = spark.createDataFrame([(0, "q", "The fornix shrank [1]. Nobody knows why [7].")], "run_id long, query_id string, answer string")
    passages = spark.createDataFrame([(0, "q", 1, "d", "Scans were read. The fornix shrank fast. It ended."), (0, "q", 2, "e", None)], "run_id long, query_id string, rank int, doc_id string, text string")
    row = A.quotes(answers, passages).first()
    assert (row.marker, row.quote) == (1, "The fornix shrank fast.")
    papers = spark.createDataFrame([("d", "Maps", ["A", "B", "C", "D"], 2001, "", "10.1/x"), ("e", None, None, 0, None, None)], "doc_id string, title string, authors array<string>, year int, url string, doi string")
    cited = spark.createDataFrame([(0, "q", 2, "e"), (0, "q", 1, "d"), (0, "q", 3, "gone")], "run_id long, query_id string, marker int, doc_id string")
    assert A.references(cited, papers).first().references == "[1] A, B, C et al. (2001). Maps. https://doi.org/10.1/x\n[2] Unknown (n.d.). e\n[3] gone"


def test_evaluate_and_arms(spark):
    docs = spark.createDataFrame([(0, f"q{i}", f"d{i}", 1 + i % 3) for i in range(12)], "run_id long, query_id string, doc_id string, doc_rank int")
    golden = spark.createDataFrame([(f"q{i}", [f"d{i}"], "answer", "rag", "both") for i in range(12)], "qid string, gold_doc_ids array<string>, expected string, stratum string, retrieval_challenge string")
    decided = docs.select("run_id", "query_id", (F.col("doc_rank") == 3).alias("refused"))
    out = E.evaluate(docs, golden, "x", {"retriever": "bm25", "embedder": "lexical"}, decided, rounds=50)
    assert out["rows"].count() == 12 and out["headline"].count() == len(E.HEADLINE) and out["refusal"].first().over_refused_qids == ["q11", "q2", "q5", "q8"]
    assert {r.part: r.fallback for r in out["labels"].collect()} == {"retriever": False, "embedder": True}
    rows = E.arm_metrics({"a": docs, "b": docs.withColumn("doc_rank", F.lit(1))}, golden)
    means = E.compare_arms(rows)
    assert E.best_arm(means, ["a", "b"]).first().arm == "a"  # equal recall_5: the first
    assert E.best_arm(means, ["a", "b"], "rr").first().arm == "b" and {r.metric for r in E.comparison_table(means).collect()} == set(E.HEADLINE)
    diff = E.paired_arms(rows, "b", "a", "rr", rounds=200).first()
    assert diff.significant and diff.ci_low > 0
    assert E.gold_positions(docs, golden).where("query_id = 'q1'").first().gold_ranks == [2]


def test_latency_and_labels(spark):
    df = spark.createDataFrame([({"a": 1.5, "b": None},), (None,)], "m map<string,double>")
    assert [r.t for r in df.select(P.total_latency(F.col("m")).alias("t")).collect()] == [1.5, None]
    assert "weighted" in P.describe(Config()) and "INSUFFICIENT_CONTEXT" in A.system_prompt()


def test_command_line(spark, tmp_path, capsys):
    from folio import cli

    docs = [("a", "Fornix maps", "The fornix shrank in old readers. They rated the maps of the fornix twice. All visits were held.", "rag", 2001), ("b", "Pons", "The pons kept its size in all readers of the second panel.", "clinical", 2010)]
    io.write_jsonl(spark.createDataFrame(docs, "doc_id string, title string, text string, stratum string, year int"), str(tmp_path / "c"))
    assert cli.main(["build", str(tmp_path / "c"), str(tmp_path / "i")], spark) == 0
    assert cli.main(["ask", str(tmp_path / "i"), "Did the fornix shrink?"], spark) == 0 and "fornix" in capsys.readouterr().out
    assert cli.main(["ask", str(tmp_path / "i"), "xyzzy", "--json"], spark) in (0, 1) and '"qid"' in capsys.readouterr().out
    assert cli.main(["ask", str(tmp_path / "i"), "Did the fornix shrink?", "--stratum", "none such"], spark) == 1
    assert cli.main(["nothing"], spark) == 2 and cli.main(["--set", "mode=odd", "ask", str(tmp_path / "i"), "x"], spark) == 1
