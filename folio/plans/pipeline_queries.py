"""Queries of the question pipeline over whole tables, and SQL that says what they compute."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.config import Config
from folio.operators import citations as A
from folio.operators import evaluation as E
from folio.operators import pipeline as P
from folio.operators import retrieval as R
from folio.plans.queries import BM25, SIGNALS, _answers, query, sql_claims, sql_index, sql_sentences, sql_tokens, sql_words, table

HEADED = "concat_ws(chr(10), header, text)"
INDEX = sql_index(HEADED, True)
DIM = R.LEXICAL_DIM
VECTORS = f"""cv AS (SELECT chunk_id, CAST(concat('0x', substr(md5(term), 1, 8)) AS BIGINT) % {DIM} AS d, sum(tf) AS w FROM post GROUP BY 1, 2), cn AS (SELECT chunk_id, d, w / sqrt(sum(w * w) OVER (PARTITION BY chunk_id)) AS w FROM cv),
qv AS (SELECT qid, CAST(concat('0x', substr(md5(term), 1, 8)) AS BIGINT) % {DIM} AS d, count(*) AS w FROM (SELECT qid, unnest({sql_tokens('question', True)}) AS term FROM (SELECT DISTINCT qid, question FROM golden)) GROUP BY 1, 2), qn AS (SELECT qid, d, w / sqrt(sum(w * w) OVER (PARTITION BY qid)) AS w FROM qv)"""
FILTERS = {"strata": ["clinical", "rag"], "year_min": 2008, "year_max": 2021, "contains": ["was"], "sections": []}
LIVE = "(SELECT chunk_id FROM chunks WHERE doc_stratum IN ('clinical', 'rag') AND doc_year BETWEEN 2008 AND 2021 AND contains(lower(text), 'was'))"


def _retrieved(mode: str, live: str = "") -> str:
    """SQL of the default pipeline in one mode; ``live``: the chunks that are left by the filters."""
    where = f"WHERE chunk_id IN {live}" if live else ""
    fused = {"weighted": "0.2::DOUBLE * dn + 0.8::DOUBLE * sn", "dense": "1.0::DOUBLE * dn", "sparse": "1.0::DOUBLE * sn", "hybrid": "coalesce(1.0::DOUBLE / (60 + dr), 0) + coalesce(1.0::DOUBLE / (60 + sr), 0)"}[mode]
    score = {"dense": "dense", "sparse": "sparse"}.get(mode, "f")
    return f"""WITH {INDEX}, live AS (SELECT * FROM post {where}), {BM25.format(post='live')}, {VECTORS},
den AS (SELECT qid, chunk_id, sum(a.w * b.w) AS score FROM qn a JOIN cn b USING (d) {where} GROUP BY 1, 2),
dtop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM den WHERE score > 0) WHERE rank <= 30),
sp AS (SELECT qid, chunk_id, score AS sparse, m FROM top WHERE rank <= 30 {"AND false" if mode == "dense" else ""}), de AS (SELECT qid, chunk_id, score AS dense FROM dtop {"WHERE false" if mode == "sparse" else ""}),
h AS (SELECT qid, chunk_id, doc_id, dense, sparse, m FROM sp FULL JOIN de USING (qid, chunk_id) JOIN (SELECT chunk_id, min(doc_id) AS doc_id FROM chunks GROUP BY 1) USING (chunk_id)),
mm AS (SELECT *, min(dense) OVER w AS dl, max(dense) OVER w AS dh, min(sparse) OVER w AS sl, max(sparse) OVER w AS sh, CASE WHEN dense IS NOT NULL THEN row_number() OVER (PARTITION BY qid ORDER BY round(dense, 9) DESC NULLS LAST, chunk_id) END AS dr, CASE WHEN sparse IS NOT NULL THEN row_number() OVER (PARTITION BY qid ORDER BY round(sparse, 9) DESC NULLS LAST, chunk_id) END AS sr FROM h WINDOW w AS (PARTITION BY qid)),
nm AS (SELECT *, CASE WHEN dense IS NULL THEN 0.0::DOUBLE WHEN dh = dl THEN 1.0 ELSE (dense - dl) / (dh - dl) END AS dn, CASE WHEN sparse IS NULL THEN 0.0::DOUBLE WHEN sh = sl THEN 1.0 ELSE (sparse - sl) / (sh - sl) END AS sn FROM mm),
fu AS (SELECT *, {fused} AS f FROM nm), r1 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(f, 9) DESC, chunk_id) AS r FROM fu), r2 AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY r, chunk_id) AS c FROM r1),
fin AS (SELECT qid, chunk_id, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY r, chunk_id) AS INTEGER) AS rank, {score} AS score, dense, sparse, m FROM r2 WHERE c <= 2)"""


def _hits(s: SparkSession, d: str, mode: str, filters: dict | None = None) -> DataFrame:
    found = P.retrieve(table(s, d, "golden"), table(s, d, "chunks"), Config(mode=mode), filters)
    return found.select(F.col("query_id").alias("qid"), "chunk_id", "doc_id", "rank", F.round("score", 6).alias("score"))


_END = " SELECT qid, chunk_id, doc_id, rank, round(score, 6) AS score FROM fin WHERE rank <= 6"


@query(_retrieved("weighted") + _END)
def retrieve_weighted(s: SparkSession, d: str) -> DataFrame:
    return _hits(s, d, "weighted")


@query(_retrieved("hybrid") + _END)
def retrieve_hybrid(s: SparkSession, d: str) -> DataFrame:
    return _hits(s, d, "hybrid")


@query(_retrieved("dense") + _END)
def retrieve_dense(s: SparkSession, d: str) -> DataFrame:
    return _hits(s, d, "dense")


@query(_retrieved("sparse") + _END)
def retrieve_sparse(s: SparkSession, d: str) -> DataFrame:
    return _hits(s, d, "sparse")


@query(_retrieved("weighted", LIVE) + _END)
def retrieve_filtered(s: SparkSession, d: str) -> DataFrame:
    return _hits(s, d, "weighted", FILTERS)


@query("SELECT DISTINCT chunk_id, section FROM chunks WHERE section IN ('Methods', 'Results') AND doc_year >= 2000 AND contains(lower(text), 'scan')")
def filter_chunks(s: SparkSession, d: str) -> DataFrame:
    return R.filter_chunks(table(s, d, "chunks"), {"sections": ["Methods", "Results"], "year_min": 2000, "contains": "SCAN", "strata": None}).select("chunk_id", "section").distinct()


@query("SELECT count(*) AS n, count(*) FILTER (false) AS n_unknown FROM chunks")
def filter_nothing(s: SparkSession, d: str) -> DataFrame:
    """An empty filter keeps all chunks, an unknown stratum none."""
    chunks = table(s, d, "chunks")
    return R.filter_chunks(chunks, {}).agg(F.count("*").alias("n")).crossJoin(R.filter_chunks(chunks, {"strata": ["no such"]}).agg(F.count("*").alias("n_unknown")))  # one row each


@query(f"WITH {INDEX}, {VECTORS} SELECT chunk_id, CAST(d AS INTEGER) AS place, round(w, 6) AS value FROM cn")
def encode_lexical(s: SparkSession, d: str) -> DataFrame:
    text = table(s, d, "chunks").select("chunk_id", R.index_text(True).alias("text"))
    return R.encode_lexical(text, "chunk_id", "text", expand=True).select("chunk_id", F.posexplode("embedding").alias("place", "value")).where("value > 0").withColumn("value", F.round("value", 6))


@query(f"WITH {sql_index('text', True)}, {BM25.format(post='post')} SELECT qid, chunk_id, round(score, 6) AS score, m AS matched_terms, rank FROM top WHERE rank <= 6")
def bm25_expanded(s: SparkSession, d: str) -> DataFrame:
    return R.bm25(table(s, d, "golden"), R.postings(table(s, d, "chunks"), expand=True), 6, expand=True).withColumn("score", F.round("score", 6))


@query(f"WITH {sql_index(HEADED)}, {BM25.format(post='post')} SELECT qid, chunk_id, round(score, 6) AS score, rank FROM top WHERE rank <= 6")
def bm25_headers(s: SparkSession, d: str) -> DataFrame:
    text = table(s, d, "chunks").select("chunk_id", R.index_text(True).alias("text"))
    return R.bm25(table(s, d, "golden"), R.postings(text), 6).drop("matched_terms").withColumn("score", F.round("score", 6))


@query("""WITH h AS (SELECT run_id, query_id, chunk_id, min(doc_id) AS doc_id, min(rank) AS rank, max(dense) AS dense, max(sparse) AS sparse, max(rerank) AS rr FROM hits GROUP BY 1, 2, 3)
SELECT run_id, query_id, chunk_id, CAST(row_number() OVER (PARTITION BY run_id, query_id ORDER BY CASE WHEN rank > 5 THEN 1 ELSE 0 END, CASE WHEN rank <= 5 THEN rr END DESC NULLS LAST, rank, chunk_id) AS INTEGER) AS rank FROM h""")
def rerank_hits(s: SparkSession, d: str) -> DataFrame:
    hits = table(s, d, "hits")
    scores = hits.groupBy("run_id", "query_id", "chunk_id").agg(F.max("rerank").alias("rr"))
    return R.rerank(R.distinct_hits(hits).join(scores, ["run_id", "query_id", "chunk_id"]), F.col("rr"), first=5).select("run_id", "query_id", "chunk_id", "rank")


@query("SELECT DISTINCT run_id, query_id, rank, chunk_id, doc_id, dense, sparse, dense_norm, sparse_norm, fused, matched_terms, 'fused' AS used, fused AS score_used FROM hits")
def explain_trace(s: SparkSession, d: str) -> DataFrame:
    return R.trace(table(s, d, "hits"), "weighted").distinct()


@query(f"WITH {SIGNALS} SELECT run_id, query_id, round(confidence, 6) AS confidence, false AS refused FROM cf")
def gate_inactive(s: SparkSession, d: str) -> DataFrame:
    """A gate without usable stats refuses nothing, whatever the confidence."""
    useless = table(s, d, "gate").withColumn("std", F.lit(None).cast("double"))
    confidence = E.gate_confidence(E.confidence_signals(table(s, d, "hits").distinct()), table(s, d, "gate")).withColumn("confidence", F.round("confidence", 6))
    return E.decide(confidence, -0.325, E.gate_is_active(useless))


@query(f"WITH {SIGNALS}, k AS (SELECT run_id, qid AS query_id FROM (SELECT DISTINCT run_id FROM hits), (SELECT DISTINCT qid FROM golden WHERE qid IS NOT NULL)) SELECT run_id, count(*) AS asked, count(*) FILTER (c.query_id IS NULL) AS without_hits, count(*) FILTER (c.query_id IS NULL OR round(confidence, 6) < -0.325 OR confidence IS NULL) AS refused FROM k LEFT JOIN cf c USING (run_id, query_id) GROUP BY 1")
def gate_without_hits(s: SparkSession, d: str) -> DataFrame:
    """Every run asked every question: those without hits are refused by an active gate."""
    hits = table(s, d, "hits")
    keys = hits.select("run_id").distinct().join(F.broadcast(table(s, d, "golden").select(F.col("qid").alias("query_id")).where("query_id is not null").distinct()))  # a stated set of questions
    found = E.gate_confidence(E.confidence_signals(hits.distinct()), table(s, d, "gate")).withColumn("confidence", F.round("confidence", 6)).withColumn("hit", F.lit(True))
    decided = E.decide(found, -0.325, True, keys)
    return decided.groupBy("run_id").agg(F.count("*").alias("asked"), F.count_if(F.col("hit").isNull()).alias("without_hits"), F.count_if("refused").alias("refused"))


@query(f"WITH {SIGNALS}, u AS (SELECT c.signal AS signal, c.x AS x FROM lg) SELECT signal, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM u GROUP BY 1")
def pooled_stats(s: SparkSession, d: str) -> DataFrame:
    rows = E.pooled_stats(E.confidence_signals(table(s, d, "hits").distinct()), ["top_dense", "mean_top3", "top_sparse", "score_gap", "n_matched"])
    return rows.select("signal", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("SELECT signal, round(mean - 0.32513 * std, 6) AS cutoff FROM gate WHERE std > 0 AND mean IS NOT NULL")
def raw_cutoffs(s: SparkSession, d: str) -> DataFrame:
    return E.raw_cutoffs(table(s, d, "gate"), -0.32513).withColumn("cutoff", F.round("cutoff", 6))


@query("SELECT DISTINCT qid, contains('Sorry: INSUFFICIENT_CONTEXT. ' || coalesce(note, ''), 'INSUFFICIENT_CONTEXT') AS sentinel, coalesce(contains(note, 'INSUFFICIENT_CONTEXT'), false) AS in_note FROM golden")
def refusal_sentinel(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "golden").select("qid", A.refusal_detected(F.concat(F.lit("Sorry: INSUFFICIENT_CONTEXT. "), F.coalesce("note", F.lit("")))).alias("sentinel"), A.refusal_detected(F.col("note")).alias("in_note")).distinct()


CITED = f"""a AS (SELECT run_id, query_id, concat('Found ', count(DISTINCT chunk_id), ' passages [1]. The best are near [2, ', 3 + run_id % 4, ']. No source says more. See also [', 9 + run_id % 5, ', 1].') AS answer FROM hits GROUP BY 1, 2),
cl AS (SELECT run_id, query_id, unnest({sql_claims('answer')}) AS claim FROM a), mk AS (SELECT run_id, query_id, {sql_words('claim')} AS w, CAST(trim(unnest(string_split(g, ','))) AS INTEGER) AS rank FROM (SELECT run_id, query_id, claim, unnest(regexp_extract_all(claim, '\\[([0-9]+(?:\\s*,\\s*[0-9]+)*)\\]', 1)) AS g FROM cl)),
mw AS (SELECT run_id, query_id, rank, list_distinct(flatten(list(w))) AS w FROM mk GROUP BY 1, 2, 3), tx AS (SELECT chunk_id, min(text) AS text FROM chunks GROUP BY 1),
pa AS (SELECT run_id, query_id, rank, min(ROW(doc_id, text)) AS p FROM hits JOIN tx USING (chunk_id) GROUP BY 1, 2, 3)"""


def _cited_passages(s: SparkSession, d: str) -> DataFrame:
    texts = table(s, d, "chunks").groupBy("chunk_id").agg(F.min("text").alias("text"))
    return table(s, d, "hits").join(texts, "chunk_id").select("run_id", "query_id", "rank", "doc_id", "text")


@query(f"""WITH {CITED.replace("min(ROW(doc_id, text)) AS p", "min(doc_id) AS doc_id")}, pb AS (SELECT run_id, query_id, rank, h.doc_id, min(text) AS text FROM hits h JOIN tx USING (chunk_id) JOIN pa USING (run_id, query_id, rank) WHERE h.doc_id = pa.doc_id GROUP BY 1, 2, 3, 4),
sp AS (SELECT run_id, query_id, rank, doc_id, w, unnest(range(len(l))) AS pos, unnest(l) AS span FROM (SELECT mw.run_id, mw.query_id, mw.rank, doc_id, w, {sql_sentences('text')} AS l FROM mw JOIN pb ON mw.run_id = pb.run_id AND mw.query_id = pb.query_id AND mw.rank = pb.rank))
SELECT run_id, query_id, rank AS marker, doc_id, span AS quote FROM (SELECT *, row_number() OVER (PARTITION BY run_id, query_id, rank ORDER BY len(list_intersect(w, {sql_words('span')})) DESC, pos) AS n FROM sp) WHERE n = 1""")
def citation_quotes(s: SparkSession, d: str) -> DataFrame:
    return A.quotes(_answers(s, d), _cited_passages(s, d)).where("quote is not null")


@query(r"""WITH a AS (SELECT run_id, query_id, concat('Found ', count(DISTINCT chunk_id), ' passages [1]. The best are near [2, ', 3 + run_id % 4, ']. No source says more. See also [', 9 + run_id % 5, ', 1].') AS answer FROM hits GROUP BY 1, 2),
mk AS (SELECT DISTINCT run_id, query_id, CAST(trim(unnest(string_split(g, ','))) AS INTEGER) AS marker FROM (SELECT run_id, query_id, unnest(regexp_extract_all(answer, '\[([0-9]+(?:\s*,\s*[0-9]+)*)\]', 1)) AS g FROM a)), rk AS (SELECT run_id, query_id, rank AS marker, min(doc_id) AS doc_id FROM hits GROUP BY 1, 2, 3),
pl AS (SELECT doc_id, min(concat(CASE WHEN coalesce(len(k), 0) = 0 THEN 'Unknown' ELSE array_to_string(k[1:3], ', ') || CASE WHEN len(k) > 3 THEN ' et al.' ELSE '' END END, ' (', coalesce(CAST(nullif(year, 0) AS VARCHAR), 'n.d.'), '). ', coalesce(title, doc_id), coalesce('. ' || coalesce(nullif(url, ''), 'https://doi.org/' || nullif(doi, '')), ''))) AS line FROM (SELECT *, list_filter(authors, lambda a: a IS NOT NULL) AS k FROM papers) WHERE doc_id IS NOT NULL GROUP BY 1)
SELECT run_id, query_id, md5(string_agg('[' || marker || '] ' || coalesce(line, doc_id), chr(10) ORDER BY marker)) AS h FROM mk JOIN rk USING (run_id, query_id, marker) LEFT JOIN pl USING (doc_id) GROUP BY 1, 2""")
def references_block(s: SparkSession, d: str) -> DataFrame:
    cited = A.resolve_citations(_answers(s, d), table(s, d, "hits"))[0]
    return A.references(cited, table(s, d, "papers")).select("run_id", "query_id", F.md5("references").alias("h"))


@query("SELECT qid, to_json({'qid': qid, 'question': question, 'category': category}) AS json FROM golden WHERE question IS NOT NULL AND category IS NOT NULL")
def answers_json(s: SparkSession, d: str) -> DataFrame:
    return P.answers_json(table(s, d, "golden").where("question is not null and category is not null").select("qid", "question", "category"))


@query(f"SELECT '{A.system_prompt()}' AS prompt, '{P.describe(Config())}' AS retriever")
def system_prompt(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(A.system_prompt(), P.describe(Config()))], "prompt string, retriever string")


@query()
def ask(s: SparkSession, d: str) -> DataFrame:
    """All questions through filter, channels, fusion, cap, gate, answer and audit."""
    gate = table(s, d, "gate")
    return P.ask(table(s, d, "golden"), table(s, d, "chunks"), Config(abstain_threshold=-0.325), None, gate).withColumn("confidence", F.round("confidence", 6))
