import pytest
from pyspark.sql import functions as F

from folio.config import Config, parse_overrides
from folio.operators import citations as A
from folio.operators import corpus as C
from folio.operators import evaluation as E
from folio.operators import retrieval as R
from folio.sources import io

# Fixed values below: 1 / (60 + rank) for rank fusion, min-max scaling, recall over gold, three of four answer points.
HIT = "run_id long, query_id string, chunk_id string, doc_id string, rank int, dense double, sparse double"


def _hits(spark, rows):
    return spark.createDataFrame([(0, "q", *r) for r in rows], HIT)


def test_bm25(spark):
    chunks = spark.createDataFrame([("a", "Swin UNETR segments"), ("b", "other words"), ("c", None), ("a", "Swin UNETR segments")], "chunk_id string, text string")
    asked = spark.createDataFrame([("q", "Swin UNETR"), ("e", ""), ("n", None), ("u", "unseen")], "qid string, question string")
    rows = R.bm25(asked, R.postings(chunks), 5).collect()
    assert [(r.qid, r.chunk_id, r["rank"], r.matched_terms) for r in rows] == [("q", "a", 1, ["swin", "unetr"])]
    assert R.bm25(asked, R.postings(chunks.limit(0)), 5).count() == 0


def test_rrf(spark):
    rows = _hits(spark, [("shared", "d", 1, 0.9, 12.0), ("dense", "e", 2, 0.5, None), ("sparse", "f", 3, None, 3.0)])
    got = R.reciprocal_rank_fusion(rows).orderBy("fused_rank").collect()
    assert got[0].chunk_id == "shared" and got[0].fused == pytest.approx(2 / 61)


def test_weighted_and_endpoints(spark):
    rows = _hits(spark, [("a", "d", 1, 0.62, 4.0), ("b", "d", 2, 0.31, 9.0), ("c", "d", 3, None, None)])
    got = {r.chunk_id: r for r in R.weighted_fusion(rows).collect()}
    assert got["a"].dense == 0.62 and got["a"].dense_norm == 1.0 and got["b"].sparse_norm == 1.0 and got["c"].fused == 0
    sweep = {(r.weight, r.chunk_id): r.fused for r in R.weight_sweep(rows, [0.0, 1.0]).collect()}
    assert sweep[1.0, "a"] == got["a"].dense_norm and sweep[0.0, "b"] == got["b"].sparse_norm


def test_cap_and_dedupe(spark):
    rows = _hits(spark, [(f"c{i}", "A" if i < 4 else "B", i + 1, 1.0, 1.0) for i in range(6)])
    kept = R.cap_per_document(rows, 2).orderBy("rank").collect()
    assert [r.chunk_id for r in kept] == ["c0", "c1", "c4", "c5"] and [r["rank"] for r in kept] == [1, 2, 3, 4]
    assert R.cap_per_document(rows, 0).count() == 6
    assert [(r.doc_id, r.doc_rank) for r in R.dedupe_by_document(rows).orderBy("doc_rank").collect()] == [("A", 1), ("B", 2)]


def test_metrics(spark):
    docs = spark.createDataFrame([(0, "q", "d1", 1), (0, "q", "d2", 2), (0, "q", "d3", 3), (0, "z", "d2", 1)], "run_id long, query_id string, doc_id string, doc_rank int")
    gold = spark.createDataFrame([("q", ["d1", "d3", "d9"]), ("z", ["d1"]), ("n", None)], "qid string, gold_doc_ids array<string>")
    got = {r.query_id: r for r in E.retrieval_metrics(docs, gold).collect()}
    assert got["q"].recall_3 == pytest.approx(2 / 3, abs=1e-6) and got["q"].rr == 1.0 and got["q"].precision_5 == 0.4 and got["q"].ap == pytest.approx((1 + 2 / 3) / 3, abs=1e-6)
    assert got["z"].recall_5 == 0 and got["z"].first_rank == 0 and all(0 <= r.ndcg_10 <= 1 for r in got.values())


def test_gate(spark):
    gate = spark.createDataFrame([("top_dense", 0.5, 0.1, 1.0), ("mean_top3", 0.5, None, 1.0)], "signal string, mean double, std double, weight double")
    rows = _hits(spark, [("a", "d", 1, 0.71, 1.0), ("b", "d", 2, 0.55, 1.0)]).withColumn("score", F.lit(1.0)).withColumn("matched_terms", F.array(F.lit("x")))
    signals = E.confidence_signals(rows)
    first = signals.first()
    assert first.top_dense == 0.71 and first.mean_top3 == pytest.approx(0.63)
    got = E.decide(E.gate_confidence(signals, gate), 0.0).first()
    assert got.confidence == pytest.approx(2.1) and got.refused is False
    labelled = spark.createDataFrame([(0.1, False), (0.5, True), (0.5, False), (0.9, True)], "confidence double, answerable boolean")
    assert E.auroc(labelled).first().auroc == pytest.approx(3.5 / 4)


def test_chunks(spark):
    text = " ".join(f"Sentence number {i} says a thing." for i in range(60))
    df = spark.createDataFrame([("a", "T", text, None), ("b", "T", "Short abstract.", []), ("c", None, None, None)], "doc_id string, title string, text string, sections array<struct<pos:int,heading:string,body:string>>")
    rows = C.chunk_documents(df, size=200, overlap=40, least=30).collect()
    mine = [r.text for r in rows if r.doc_id == "a"]
    assert len(mine) > 1 and all(len(t) <= 260 for t in mine) and all(f"Sentence number {i} says" in " ".join(mine) for i in range(60))
    assert [(r.text, r.header) for r in rows if r.doc_id == "b"] == [("Short abstract.", "T > Abstract")] and not [r for r in rows if r.doc_id == "c"]


def test_upper_median_and_dedupe(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "v int")
    assert C.upper_median(df, "v").first().median == 3
    docs = spark.createDataFrame([("a", "T", "10.1/X", "long text"), ("b", "T", "https://doi.org/10.1/x", "x"), ("c", None, None, None), ("d", " t ", "", "y")], "doc_id string, title string, doi string, text string")
    assert {r.doc_id: r.records for r in C.dedupe_documents(docs).collect()} == {"a": 2, "c": 1, "d": 1}


def test_citations(spark):
    answers = spark.createDataFrame([(0, "q", "Claim [1] and invented [7].")], "run_id long, query_id string, answer string")
    good, bad = A.resolve_citations(answers, _hits(spark, [("a", "d", 1, 1.0, 1.0)]))
    assert [r.marker for r in good.collect()] == [1] and [r.marker for r in bad.collect()] == [7]
    points = spark.createDataFrame([("q", ["OASIS", "ADNI", "CNN", "Swin UNETR"])], "qid string, answer_points array<string>")
    got = A.answer_correctness(spark.createDataFrame([("q", "We used OASIS and ADNI with a CNN.")], "qid string, answer string"), points).first()
    assert got.correctness == 0.75 and got.missing == ["Swin UNETR"]
    same = spark.createDataFrame([("q", 1, "The model was trained well.")], "qid string, rank int, text string")
    assert A.faithfulness(spark.createDataFrame([("q", "The model was trained well. [1]")], "qid string, answer string"), same).first().faithfulness == 1.0
    asked = spark.createDataFrame([("q", ["mongolia"])], "qid string, terms array<string>")
    assert C.extractive_answers(asked, same).first().answer == "INSUFFICIENT_CONTEXT"


def test_config():
    base = Config()
    assert base.merge({"top_k": 3}).top_k == 3 and base.top_k == 6 and Config.from_dict({"nope": 1, "top_k": 2}).top_k == 2
    assert parse_overrides(["top_k=10", "rerank=false", "dense_weight=0.25", "abstain_threshold=null"]) == {"top_k": 10, "rerank": False, "dense_weight": 0.25, "abstain_threshold": None}
    assert base.merge({"chunk_overlap": 900}).warnings() and not base.warnings()


def test_io(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("b", None)], "doc_id string, text string")
    assert io.write_jsonl(df, str(tmp_path / "d")) == 2
    assert io.read_jsonl(spark, str(tmp_path / "d"), io.DOCUMENT).count() == 2
    chunks = df.withColumn("chunk_id", F.col("doc_id")).withColumn("doc_stratum", F.lit("rag"))
    io.save_index(str(tmp_path / "i"), chunks, R.postings(chunks), "lexical")
    assert io.load_index(spark, str(tmp_path / "i"), "lexical")[1].count() == 1
    with pytest.raises(ValueError):
        io.load_index(spark, str(tmp_path / "i"), "other")


def test_plans_filter_and_cut_below_exchange(spark):
    rows = _hits(spark, [("a", "d", 1, 0.9, 1.0)])
    plan = R.top_k(rows, 3, ["query_id"], "dense")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_signal_selection_equals_brute_force(spark):
    import random
    from statistics import mean, pstdev

    rng = random.Random(6)
    rows = [(rng.gauss(0.5 if i % 3 else 0.1, 0.2), rng.gauss(0.0, 1.0), bool(i % 3)) for i in range(90)]
    got = {r.signals: r for r in E.select_signals(spark.createDataFrame(rows, "a double, b double, answerable boolean"), ["a", "b"]).collect()}
    z = [[(r[k] - mean(x[k] for x in rows)) / pstdev(x[k] for x in rows) for r in rows] for k in (0, 1)]
    for name, used in (("a", [0]), ("b", [1]), ("a+b", [0, 1])):
        best = None
        for t in [i / 10 for i in range(-20, 21)]:
            low = [sum(z[k][i] for k in used) / len(used) < t for i in range(len(rows))]
            tr = sum(x and not r[2] for x, r in zip(low, rows)) / sum(not r[2] for r in rows)
            fr = sum(x and r[2] for x, r in zip(low, rows)) / sum(r[2] for r in rows)
            if fr <= 0.15:
                best = max(best or (0, 0), ((tr + 1 - fr) / 2, -t))
        assert got[name].balanced_accuracy == pytest.approx(best[0], abs=1e-6) and got[name].threshold == pytest.approx(-best[1])
    assert sum(r.chosen for r in got.values()) == 1


def test_signal_selection_tries_every_score_of_every_subset(spark):
    import random
    from itertools import combinations
    from statistics import mean, pstdev

    from folio.plans.queries import signal_subsets

    rng = random.Random(8)
    # a far value squeezes the others into a tenth of a step or two
    rows = [(round(rng.gauss(0.02 if i % 3 else 0.0, 0.01), 3), float(rng.randrange(4)), bool(i % 3)) for i in range(90)] + [(9.0, 1.0, True)]
    got = {r.signals: r for r in E.select_signals(spark.createDataFrame(rows, "a double, b double, answerable boolean"), ["a", "b"], grid=None).collect()}
    z = [[(r[k] - mean(x[k] for x in rows)) / pstdev(x[k] for x in rows) for r in rows] for k in (0, 1)]
    for name, used in (("a", [0]), ("b", [1]), ("a+b", [0, 1])):
        best = 0
        x = [round(sum(z[k][i] for k in used) / len(used), 9) for i in range(len(rows))]
        for t in set(x):
            tr = sum(v < t and not r[2] for v, r in zip(x, rows)) / sum(not r[2] for r in rows)
            fr = sum(v < t and r[2] for v, r in zip(x, rows)) / sum(r[2] for r in rows)
            if fr <= 0.15:
                best = max(best, (tr + 1 - fr) / 2)
        assert got[name].balanced_accuracy == pytest.approx(best, abs=1e-6)
    names = ["top_dense", "mean_top3", "top_sparse", "score_gap", "n_matched"]
    hits = spark.createDataFrame([(0, f"q{i}", "c", "d", 1, 0.1 * i, 1.0 * i, 1.0, ["x"] * i) for i in range(4)], HIT + ", score double, matched_terms array<string>")
    golden = spark.createDataFrame([(f"q{i}", "answer" if i > 1 else "refuse") for i in range(4)], "qid string, expected string")
    import tempfile

    with tempfile.TemporaryDirectory() as d:
        hits.write.parquet(f"{d}/hits.parquet")
        golden.write.parquet(f"{d}/golden.parquet")
        assert {r.signals for r in signal_subsets(spark, d).collect()} == {"+".join(c) for k in range(1, 6) for c in combinations(names, k)}


def test_bootstrap_has_2000_rounds_and_tells_significance(spark):
    import inspect

    assert inspect.signature(E.bootstrap).parameters["rounds"].default == 2000
    df = spark.createDataFrame([(f"q{i:02d}", 0.5 + 0.01 * i, 0.1 * (-1) ** i) for i in range(30)], "q string, up double, even double")
    got = E.paired_bootstrap(df, "q", "up").first()
    assert got.significant and got.ci_low < got.mean < got.ci_high
    assert not E.paired_bootstrap(df, "q", "even").first().significant
