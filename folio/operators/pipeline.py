"""Questions to hits and answers in one plan, keyed by question: filter, channels, fusion, rerank, cap, gate, answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.config import Config
from folio.functions.text import tokens
from folio.operators import citations as A
from folio.operators import corpus as C
from folio.operators import evaluation as E
from folio.operators import retrieval as R

MODES = ("weighted", "hybrid", "dense", "sparse")
_HIT = ["run_id", "query_id", "chunk_id", "doc_id", "rank", "score", "dense", "sparse", "dense_norm", "sparse_norm", "fused", "matched_terms"]


def describe(config: Config) -> str:
    """What the retriever does, in words."""
    parts = {"weighted": f"weighted fusion, dense weight {config.dense_weight}", "hybrid": f"rank fusion, k {config.rrf_k}", "dense": "dense only", "sparse": "BM25 only"}
    return f"{parts[config.mode]}; {config.candidate_k} candidates a channel, at most {config.max_chunks_per_doc} chunks of a document, top {config.top_k}" + ("; reranked" if config.rerank else "")


def retrieve(questions: DataFrame, chunks: DataFrame, config: Config = Config(), filters: dict | None = None, postings: DataFrame | None = None, vectors: DataFrame | None = None, reranker=None) -> DataFrame:
    """Ranked hits of all questions (qid, question). Filters restrict the chunks before scoring, statistics stay those of
    the whole index. A channel that the mode does not use is not built. ``postings`` and ``vectors`` (chunk_id,
    embedding) of a saved index are used where given; else chunks are indexed here, vectors by the offline encoder.
    Empty questions have no hits."""
    if config.mode not in MODES:
        raise ValueError(f"mode {config.mode} is none of {', '.join(MODES)}")
    once = chunks.where("chunk_id is not null").dropDuplicates(["chunk_id"])
    text = once.withColumn("text", R.index_text(config.contextual_headers)).select("chunk_id", "text")
    condition = R.chunk_filter(filters)
    keep = None if condition is None else once.where(condition).select("chunk_id")
    zero = F.lit(0).cast("long").alias("run_id")
    sparse = dense = None
    if config.mode != "dense":
        post = postings if postings is not None else R.postings(text, expand=config.expand_acronyms)
        found = R.bm25(questions, post, config.candidate_k, keep, expand=config.expand_acronyms)
        sparse = found.select(zero, F.col("qid").alias("query_id"), "chunk_id", F.lit(None).cast("double").alias("dense"), F.col("score").alias("sparse"), "matched_terms")
    if config.mode != "sparse":
        made = vectors if vectors is not None else R.encode_lexical(text, "chunk_id", "text", expand=config.expand_acronyms)
        live = made if keep is None else made.join(keep, "chunk_id", "left_semi")
        asked = R.encode_lexical(questions, "qid", "question", expand=config.expand_acronyms)
        near = R.dense_topk(asked.select(F.col("qid").alias("query_id"), F.col("embedding").alias("q")), live.withColumnRenamed("chunk_id", "vec_id"), config.candidate_k, exclude_same=False).where("score > 0")
        dense = near.select(zero, "query_id", F.col("vec_id").alias("chunk_id"), F.col("score").alias("dense"), F.lit(None).cast("double").alias("sparse"), F.lit(None).cast("array<string>").alias("matched_terms"))
    both = dense if sparse is None else sparse if dense is None else sparse.unionByName(dense)
    hits = both.groupBy("run_id", "query_id", "chunk_id").agg(F.max("dense").alias("dense"), F.max("sparse").alias("sparse"), F.max("matched_terms").alias("matched_terms"))
    hits = hits.join(once.select("chunk_id", "doc_id"), "chunk_id")
    if config.mode == "hybrid":
        ranked = R.reciprocal_rank_fusion(R.min_max(hits), config.rrf_k)
    else:
        weight = {"weighted": config.dense_weight, "dense": 1.0, "sparse": 0.0}[config.mode]
        ranked = R.weighted_fusion(hits, weight)
    ranked = ranked.withColumn("rank", F.col("fused_rank")).withColumn("score", F.col({"dense": "dense", "sparse": "sparse"}.get(config.mode, "fused")))
    if config.rerank and reranker is not None:
        ranked = R.rerank(ranked, reranker, config.rerank_candidates)
    return R.cap_per_document(ranked, config.max_chunks_per_doc).where(F.col("rank") <= config.top_k).select(*_HIT)


def ask(questions: DataFrame, chunks: DataFrame, config: Config = Config(), filters: dict | None = None, gate: DataFrame | None = None, hits: DataFrame | None = None, **index) -> DataFrame:
    """One row for each question: answer, refused, refusal_reason, confidence, citations (marker, doc_id, quote in order),
    fabricated markers, citation_coverage, unique_sources, passages_supplied, backend. The gate decides before any answer
    is made; a threshold that is not set leaves it inactive. A question without a fitting sentence is refused too."""
    hits = retrieve(questions, chunks, config, filters, **index) if hits is None else hits
    hits = R.materialize(hits, "hits")  # read by the gate, the answers and the citations
    keys = questions.select(F.lit(0).cast("long").alias("run_id"), F.col("qid").alias("query_id")).where("query_id is not null").distinct()
    active = gate is not None and config.abstain and config.abstain_threshold is not None and E.gate_is_active(gate)
    if active:
        decided = E.decide(E.gate_confidence(E.confidence_signals(hits), gate), config.abstain_threshold, True, keys)
    else:
        decided = E.decide(keys.withColumn("confidence", F.lit(None).cast("double")), 0.0, False)
    decided = R.materialize(decided, "decided")
    texts = chunks.where("chunk_id is not null").groupBy("chunk_id").agg(F.min("text").alias("text"))
    passages = hits.join(decided.where("not refused"), ["run_id", "query_id"], "left_semi").join(texts, "chunk_id").select("run_id", "query_id", "rank", "doc_id", "text")
    terms = questions.select("qid", F.array_distinct(tokens(F.col("question"), config.expand_acronyms)).alias("terms"))
    made = C.extractive_answers(terms, passages.withColumnRenamed("query_id", "qid").select("qid", "rank", "text"))
    answers = R.materialize(decided.join(made.withColumnRenamed("qid", "query_id"), "query_id").select(
        "run_id", "query_id", "confidence", F.when(F.col("refused"), F.lit(config.refusal_token)).otherwise(F.col("answer")).alias("answer"),
        F.when(F.col("refused"), "gate").when(A.refusal_detected(F.col("answer")), "no_support").alias("refusal_reason")), "answers")
    cited = A.quotes(answers, passages).groupBy("run_id", "query_id").agg(F.array_sort(F.collect_list(F.struct("marker", "doc_id", "quote"))).alias("citations"))
    lost = A.resolve_citations(answers, hits)[1].groupBy("run_id", "query_id").agg(F.array_sort(F.collect_list("marker")).alias("fabricated_markers"))
    rows = answers.join(cited, ["run_id", "query_id"], "left").join(lost, ["run_id", "query_id"], "left").join(A.audit(answers, hits), ["run_id", "query_id"], "left")
    return rows.select(
        F.col("query_id").alias("qid"), "answer", F.col("refusal_reason").isNotNull().alias("refused"), "refusal_reason", "confidence", F.coalesce("citations", F.array().cast("array<struct<marker:int,doc_id:string,quote:string>>")).alias("citations"),
        F.coalesce("fabricated_markers", F.array().cast("array<int>")).alias("fabricated_markers"), "citation_coverage", "unique_sources", "passages_supplied", F.lit("extractive").alias("backend"),
    )


def answers_json(answers: DataFrame) -> DataFrame:
    """qid, json: each answer as one JSON text; null fields are left out."""
    return answers.select("qid", F.to_json(F.struct(*[c for c in answers.columns])).alias("json"))


def total_latency(stages: F.Column) -> F.Column:
    """The sum of a map of stage to milliseconds; null stages count 0."""
    return F.aggregate(F.map_values(stages), F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))
