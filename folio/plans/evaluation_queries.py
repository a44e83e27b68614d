"""Queries of the evaluation over whole tables, and SQL that says what they compute."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import citations as A
from folio.operators import evaluation as E
from folio.operators import retrieval as R
from folio.plans.queries import ANSWERS, BOOT_2000, DOCS, METRICS, NORM, _answers, _doc_hits, _metrics, query, signal_subsets, table

WEIGHTS = [0.0, 0.2, 0.5, 0.8, 1.0]
ARMS = ("bm25_only", "weighted_0.2", "weighted_0.5", "dense_only", "rrf")
_GRID = f"{NORM}, k AS (SELECT *, CASE WHEN dense IS NOT NULL THEN row_number() OVER (PARTITION BY run_id, query_id ORDER BY dense DESC NULLS LAST, chunk_id) END AS dr, CASE WHEN sparse IS NOT NULL THEN row_number() OVER (PARTITION BY run_id, query_id ORDER BY sparse DESC NULLS LAST, chunk_id) END AS sr FROM nm)"


def _arm_rows(arms: str) -> str:
    """SQL of per-question metrics of each arm; ``arms``: rows (arm, fused, k.*)."""
    ranked = f"ar AS (SELECT arm, run_id, query_id, doc_id, row_number() OVER (PARTITION BY arm, run_id, query_id ORDER BY round(fused, 9) DESC, chunk_id) AS rank FROM ({arms}))"
    body = METRICS.replace("FROM hits GROUP BY 1, 2, 3)", "FROM ar GROUP BY 1, 2, 3, 4)", 1).replace("SELECT run_id, query_id, doc_id, min(rank) AS r", "SELECT arm, run_id, query_id, doc_id, min(rank) AS r")
    body = body.replace("SELECT run_id, query_id, doc_id, CAST(", "SELECT arm, run_id, query_id, doc_id, CAST(").replace("PARTITION BY run_id, query_id", "PARTITION BY arm, run_id, query_id").replace("s AS (SELECT run_id, query_id,", "s AS (SELECT arm, run_id, query_id,").replace("FROM f GROUP BY 1, 2)", "FROM f GROUP BY 1, 2, 3)")
    body = body.replace("m AS (SELECT a.run_id", "m AS (SELECT a.arm, a.run_id").replace("SELECT DISTINCT run_id, query_id FROM d", "SELECT DISTINCT arm, run_id, query_id FROM d").replace("LEFT JOIN s USING (run_id, query_id)", "LEFT JOIN s USING (arm, run_id, query_id)")
    return f"WITH {_GRID}, {ranked}, {body}"


_W = "SELECT {arm} AS arm, {w}::DOUBLE * dn + (1 - {w}::DOUBLE) * sn AS fused, * FROM k"
_RRF = "SELECT 'rrf' AS arm, coalesce(1.0::DOUBLE / (60 + dr), 0) + coalesce(1.0::DOUBLE / (60 + sr), 0) AS fused, * FROM k"
COMPARE = _arm_rows(" UNION ALL ".join([*(_W.format(arm=f"'{a}'", w=w) for a, w in (("bm25_only", 0.0), ("weighted_0.2", 0.2), ("weighted_0.5", 0.5), ("dense_only", 1.0))), _RRF]))
SWEEP = _arm_rows(" UNION ALL ".join([*(_W.format(arm=f"'weight {w}'", w=w) for w in WEIGHTS), _RRF]))
MEANS = "count(*) AS n, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in E.HEADLINE)


def _documents(ranked: DataFrame) -> DataFrame:
    return R.dedupe_by_document(ranked, "fused_rank")


def _arms(s: SparkSession, d: str) -> DataFrame:
    scaled = R.materialize(R.min_max(R.distinct_hits(table(s, d, "hits"))), "scaled")  # shared by the arms
    arms = {"bm25_only": 0.0, "weighted_0.2": 0.2, "weighted_0.5": 0.5, "dense_only": 1.0}
    found = {a: _documents(R.weighted_fusion(scaled, w)) for a, w in arms.items()}
    return E.arm_metrics(found | {"rrf": _documents(R.reciprocal_rank_fusion(scaled))}, table(s, d, "golden"))


@query(f"{COMPARE} SELECT arm, {MEANS} FROM m GROUP BY 1")
def compare_arms(s: SparkSession, d: str) -> DataFrame:
    return E.compare_arms(_arms(s, d))


@query(f"SELECT *, ci_low > 0 OR ci_high < 0 AS significant FROM ({COMPARE}, q AS (SELECT query_id, avg(recall_5) FILTER (arm = 'weighted_0.2') - avg(recall_5) FILTER (arm = 'bm25_only') AS v FROM m GROUP BY 1), {BOOT_2000})")
def paired_arms(s: SparkSession, d: str) -> DataFrame:
    return E.paired_arms(_arms(s, d), "weighted_0.2", "bm25_only")


@query(f"{COMPARE}, a AS (SELECT arm, {MEANS} FROM m GROUP BY 1), u AS (UNPIVOT (SELECT arm, {', '.join(E.HEADLINE)} FROM a) ON {', '.join(E.HEADLINE)} INTO NAME metric VALUE v) SELECT metric, " + ", ".join(f"max(v) FILTER (arm = '{a}') AS \"{a}\"" for a in ARMS) + " FROM u GROUP BY 1")
def comparison_table(s: SparkSession, d: str) -> DataFrame:
    return E.comparison_table(E.compare_arms(_arms(s, d)))


def _sweep(s: SparkSession, d: str) -> DataFrame:
    """All weights ranked in one plan, and rank fusion, with the metrics of each."""
    hits = R.materialize(R.distinct_hits(table(s, d, "hits")), "hits")
    golden = table(s, d, "golden")
    weights = R.weight_sweep(hits, WEIGHTS).withColumn("arm", F.concat(F.lit("weight "), F.col("weight").cast("string")))
    by = ("arm", "run_id", "query_id")
    docs = R.dedupe_by_document(weights, "fused_rank", by).unionByName(R.dedupe_by_document(R.reciprocal_rank_fusion(hits).withColumn("arm", F.lit("rrf")), "fused_rank", by))
    return E.compare_arms(E.retrieval_metrics(docs, golden, by))


@query(f"{SWEEP} SELECT arm, {MEANS} FROM m GROUP BY 1")
def sweep_metrics(s: SparkSession, d: str) -> DataFrame:
    return _sweep(s, d)


@query(f"{SWEEP}, a AS (SELECT arm, {MEANS} FROM m GROUP BY 1) SELECT * FROM a ORDER BY recall_5 DESC, list_position({[f'weight {w}' for w in WEIGHTS] + ['rrf']}, arm) LIMIT 1")
def best_weight(s: SparkSession, d: str) -> DataFrame:
    return E.best_arm(_sweep(s, d), [f"weight {w}" for w in WEIGHTS] + ["rrf"])


@query(f"""WITH {DOCS}, e AS (SELECT DISTINCT qid, unnest(gold_doc_ids) AS g FROM golden) SELECT run_id, query_id, list(doc_id ORDER BY doc_rank) AS retrieved, coalesce(list(doc_rank ORDER BY doc_rank) FILTER (e.qid IS NOT NULL), []) AS gold_ranks
FROM d LEFT JOIN e ON d.query_id = e.qid AND d.doc_id = e.g WHERE query_id IN (SELECT qid FROM e WHERE g IS NOT NULL) GROUP BY 1, 2""")
def gold_ranks(s: SparkSession, d: str) -> DataFrame:
    return E.gold_positions(_doc_hits(s, d), table(s, d, "golden"))


@query("""WITH e AS (SELECT DISTINCT qid AS query_id, unnest(gold_doc_ids) AS doc_id FROM golden), n AS (SELECT query_id, count(doc_id) AS n FROM e GROUP BY 1 HAVING count(doc_id) > 0), h AS (SELECT DISTINCT run_id, query_id, doc_id FROM hits)
SELECT run_id, query_id, round(count(e.doc_id) / count(*), 6) AS context_precision, round(count(e.doc_id) / max(n), 6) AS context_recall FROM h JOIN n USING (query_id) LEFT JOIN e USING (query_id, doc_id) GROUP BY 1, 2""")
def context_scores(s: SparkSession, d: str) -> DataFrame:
    return A.context_scores(table(s, d, "hits"), table(s, d, "golden"))


@query(f"WITH {ANSWERS} SELECT count(*) AS markers, CAST(count(*) FILTER (rk.marker IS NULL) AS BIGINT) AS fabricated, round(avg((rk.marker IS NULL)::INTEGER), 6) AS rate FROM mk LEFT JOIN rk USING (run_id, query_id, marker)")
def fabricated_rate(s: SparkSession, d: str) -> DataFrame:
    return A.fabricated_rate(_answers(s, d), table(s, d, "hits"))


@query(f"WITH {METRICS} SELECT m.query_id AS qid, m.run_id, g.question, m.recall_5, m.rr, m.ndcg_10 FROM m JOIN golden g ON g.qid = m.query_id")
def flat_metrics(s: SparkSession, d: str) -> DataFrame:
    """Nested metrics flattened beside their question."""
    nested = _metrics(s, d).select(F.col("query_id").alias("qid"), "run_id", F.struct("recall_5", "rr", "ndcg_10").alias("metrics"))
    return nested.join(table(s, d, "golden").select("qid", "question"), "qid").select("qid", "run_id", "question", "metrics.*")


@query(r"""WITH t AS (SELECT qid, list_distinct(regexp_extract_all(lower(question), '[\p{L}\p{N}]+')) AS q, list_distinct(regexp_extract_all(lower(note), '[\p{L}\p{N}]+')) AS a FROM golden WHERE note IS NOT NULL) SELECT DISTINCT qid, round(len(list_intersect(q, a)) / (sqrt(len(q)) * sqrt(len(a))), 6) AS relevancy FROM t WHERE len(q) > 0 AND len(a) > 0""")
def answer_relevancy(s: SparkSession, d: str) -> DataFrame:
    """Cosine of the words of question and answer (here: the note), without an encoder."""
    rows = table(s, d, "golden").where("note is not null").select("qid", A.words_of(F.regexp_replace("question", r"[\[\]]", " ")).alias("q"), A.words_of(F.regexp_replace("note", r"[\[\]]", " ")).alias("a")).where("size(q) > 0 and size(a) > 0")
    return rows.select("qid", F.round(A.word_cosine(F.col("q"), F.col("a")), 6).alias("relevancy")).distinct()


@query()
def best_subsets(s: SparkSession, d: str) -> DataFrame:
    """The eight best subsets of signals, the chosen one marked."""
    return E.mark_subsets(signal_subsets(s, d)).select("place", "signals", "size", "threshold", "balanced_accuracy", "mark")
