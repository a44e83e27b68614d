"""Queries of the engine's own operators over whole tables, and SQL that says what they compute."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.operators import citations as A
from folio.operators import corpus as C
from folio.operators import evaluation as E
from folio.operators import retrieval as R
from folio.session import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

def sql_tokens(c: str, expand: bool = False) -> str:
    """``X.tokens`` as SQL: the list of terms of a text."""
    each = "CASE WHEN contains(t, '-') THEN list_concat([t], string_split(t, '-')) ELSE [t] END"
    out = rf"flatten(list_transform(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+(?:-[\p{{L}}\p{{N}}]+)*'), lambda t: {each}))"
    if expand:
        cases = " ".join(f"WHEN '{k}' THEN {[k, *v]}" for k, v in X.ACRONYMS.items())
        out = f"flatten(list_transform({out}, lambda t: CASE t {cases} ELSE [t] END))"
    return out


def sql_sentences(c: str) -> str:
    """``X.split_sentences`` as SQL."""
    for a in X.ABBREVIATIONS:
        c = f"replace({c}, '{a}', '{a}'.replace('.', chr(2)))".replace(f"'{a}'.replace('.', chr(2))", f"replace('{a}', '.', chr(2))")
    marked = f"regexp_replace({c}, '([.!?])\\s+', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: regexp_replace(replace(s, chr(2), '.'), '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"


def sql_claims(c: str) -> str:
    """``X.claims`` as SQL."""
    marker = "\\[[0-9]+(?:\\s*,\\s*[0-9]+)*\\]"
    return sql_sentences(f"regexp_replace({c}, '([.!?])\\s+({marker}(?:\\s*{marker})*)', ' \\2\\1', 'g')")


def sql_words(c: str) -> str:
    """``A.words_of`` as SQL."""
    return f"list_distinct(regexp_extract_all(lower(regexp_replace({c}, '\\[[0-9, ]+\\]', ' ', 'g')), '([\\p{{L}}\\p{{N}}]+)', 1))"


def sql_index(text: str = "text", expand: bool = False) -> str:
    """Common table expressions of the index and the asked terms."""
    return f"""tok AS (SELECT chunk_id, {sql_tokens("text", expand)} AS t FROM (SELECT DISTINCT chunk_id, {text} AS text FROM chunks WHERE chunk_id IS NOT NULL)),
post AS (SELECT chunk_id, term, count(*) AS tf, max(dl) AS dl FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT chunk_id, max(dl) AS dl FROM post GROUP BY 1)),
idf AS (SELECT term, count(*) AS df, ln(1 + ((SELECT n FROM st) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post GROUP BY 1),
asked AS (SELECT DISTINCT qid, unnest({sql_tokens("question", expand)}) AS term FROM golden)"""


TOKENS = sql_index()
BM25 = """scored AS (SELECT qid, chunk_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score, list_sort(list(DISTINCT term)) AS m FROM {post} JOIN asked USING (term) JOIN idf USING (term), st GROUP BY 1, 2),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS INTEGER) AS rank FROM scored)"""
HITS = "h AS (SELECT run_id, query_id, chunk_id, min(doc_id) AS doc_id, min(rank) AS rank, max(dense) AS dense, max(sparse) AS sparse FROM hits GROUP BY 1, 2, 3)"
NORM = HITS + """, mm AS (SELECT *, min(dense) OVER w AS dl, max(dense) OVER w AS dh, min(sparse) OVER w AS sl, max(sparse) OVER w AS sh FROM h WINDOW w AS (PARTITION BY run_id, query_id)),
nm AS (SELECT *, CASE WHEN dense IS NULL THEN 0.0::DOUBLE WHEN dh = dl THEN 1.0 ELSE (dense - dl) / (dh - dl) END AS dn, CASE WHEN sparse IS NULL THEN 0.0::DOUBLE WHEN sh = sl THEN 1.0 ELSE (sparse - sl) / (sh - sl) END AS sn FROM mm)"""
DOCS = "r AS (SELECT run_id, query_id, doc_id, min(rank) AS r FROM hits GROUP BY 1, 2, 3), d AS (SELECT run_id, query_id, doc_id, CAST(row_number() OVER (PARTITION BY run_id, query_id ORDER BY r, doc_id) AS INTEGER) AS doc_rank FROM r)"
METRICS = DOCS + """, e AS (SELECT DISTINCT qid, unnest(gold_doc_ids) AS doc_id FROM golden), ng AS (SELECT qid, count(*) AS n_gold FROM e WHERE doc_id IS NOT NULL GROUP BY 1),
f AS (SELECT d.*, row_number() OVER (PARTITION BY run_id, query_id ORDER BY doc_rank) AS nth FROM d JOIN e ON d.query_id = e.qid AND d.doc_id = e.doc_id),
s AS (SELECT run_id, query_id, count(*) FILTER (doc_rank <= 1) AS g1, count(*) FILTER (doc_rank <= 3) AS g3, count(*) FILTER (doc_rank <= 5) AS g5, count(*) FILTER (doc_rank <= 10) AS g10, min(doc_rank) AS first, sum(nth / doc_rank) AS ap, sum(CASE WHEN doc_rank <= 10 THEN 1 / log2(doc_rank + 1.0) END) AS dcg FROM f GROUP BY 1, 2),
m AS (SELECT a.run_id, a.query_id, n_gold, round(coalesce(g1, 0) / n_gold, 6) AS recall_1, round(coalesce(g3, 0) / n_gold, 6) AS recall_3, round(coalesce(g5, 0) / n_gold, 6) AS recall_5, round(coalesce(g10, 0) / n_gold, 6) AS recall_10, round(coalesce(g5, 0) / 5, 6) AS precision_5,
CAST(coalesce(g5, 0) > 0 AS INTEGER) AS hit_5, round(coalesce(1.0 / first, 0)::DOUBLE, 6) AS rr, round(coalesce(ap, 0) / n_gold, 6) AS ap, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_gold, 10) + 1), lambda i: 1 / log2(i + 1.0))), 6) AS ndcg_10, CAST(coalesce(first, 0) AS INTEGER) AS first_rank
FROM (SELECT DISTINCT run_id, query_id FROM d) a JOIN ng ON a.query_id = ng.qid LEFT JOIN s USING (run_id, query_id))"""
SIGNALS = """sg AS (SELECT run_id, query_id, max(CASE WHEN rank = 1 THEN dense END) AS top_dense, avg(CASE WHEN rank <= 3 THEN dense END) AS mean_top3, max(CASE WHEN rank = 1 THEN sparse END) AS top_sparse, max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END) AS score_gap, CAST(max(CASE WHEN rank = 1 THEN len(list_distinct(matched_terms)) END) AS DOUBLE) AS n_matched FROM (SELECT DISTINCT * FROM hits) GROUP BY 1, 2),
lg AS (SELECT run_id, query_id, unnest([{{'signal': 'top_dense', 'x': top_dense}}, {{'signal': 'mean_top3', 'x': mean_top3}}, {{'signal': 'top_sparse', 'x': top_sparse}}, {{'signal': 'score_gap', 'x': score_gap}}, {{'signal': 'n_matched', 'x': n_matched}}]) AS c FROM sg),
cf AS (SELECT run_id, query_id, sum(CASE WHEN std > 0 AND weight > 0 AND c.x IS NOT NULL THEN weight * (c.x - mean) / std END) / nullif(sum(CASE WHEN std > 0 AND weight > 0 AND c.x IS NOT NULL THEN weight END), 0) AS confidence FROM lg LEFT JOIN gate ON c.signal = gate.signal GROUP BY 1, 2),
lab AS (SELECT round(confidence, 6) AS confidence, expected = 'answer' AS answerable FROM cf JOIN golden ON query_id = qid WHERE confidence IS NOT NULL)""".replace("{{", "{").replace("}}", "}")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _post(s: SparkSession, d: str) -> DataFrame:
    return materialize(R.postings(table(s, d, "chunks")), "postings")


@query(f"WITH {TOKENS}, {BM25.format(post='post')} SELECT qid, chunk_id, round(score, 6) AS score, m AS matched_terms, rank FROM top WHERE rank <= 6")
def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    return R.bm25(table(s, d, "golden"), _post(s, d), 6).withColumn("score", F.round("score", 6))


@query(f"WITH {TOKENS}, live AS (SELECT * FROM post WHERE chunk_id IN (SELECT chunk_id FROM chunks WHERE doc_stratum IN ('clinical', 'rag') AND doc_year BETWEEN 2010 AND 2020 AND contains(lower(text), 'was'))), {BM25.format(post='live')} SELECT qid, chunk_id, round(score, 6) AS score, rank FROM top WHERE rank <= 6")
def bm25_prefiltered(s: SparkSession, d: str) -> DataFrame:
    keep = table(s, d, "chunks").where(F.col("doc_stratum").isin("clinical", "rag") & F.col("doc_year").between(2010, 2020) & F.contains(F.lower("text"), F.lit("was")))
    return R.bm25(table(s, d, "golden"), _post(s, d), 6, keep).drop("matched_terms").withColumn("score", F.round("score", 6))


@query(f"WITH {TOKENS} SELECT term, df, round(idf, 9) AS idf FROM idf")
def bm25_idf(s: SparkSession, d: str) -> DataFrame:
    post = _post(s, d)
    return R.idf(post, R.index_stats(post)).withColumn("idf", F.round("idf", 9))


@query(f"WITH {TOKENS} SELECT chunk_id, term, tf, CAST(dl AS INTEGER) AS dl FROM post")
def tokenize_hyphen(s: SparkSession, d: str) -> DataFrame:
    return _post(s, d)


@query(f"WITH {TOKENS} SELECT (SELECT n FROM st) AS n, round((SELECT avgdl FROM st), 6) AS avgdl, (SELECT count(DISTINCT term) FROM post) AS terms")
def vocab_stats(s: SparkSession, d: str) -> DataFrame:
    return R.index_stats(_post(s, d)).withColumn("avgdl", F.round("avgdl", 6))


@query(r"""WITH t AS (SELECT qid, unnest(regexp_extract_all(lower(question), '[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*')) AS w FROM golden), p AS (SELECT qid, unnest(CASE WHEN contains(w, '-') THEN list_concat([w], string_split(w, '-')) ELSE [w] END) AS w FROM t),
x AS (SELECT qid, w FROM p UNION ALL SELECT qid, unnest(a.e) FROM p JOIN (VALUES ('ad', ['alzheimer', 'disease']), ('mri', ['magnetic', 'resonance', 'imaging']), ('mci', ['mild', 'cognitive', 'impairment']), ('pet', ['positron', 'emission', 'tomography']), ('csf', ['cerebrospinal', 'fluid']), ('rag', ['retrieval', 'augmented', 'generation'])) a(k, e) ON w = k) SELECT qid, w AS term, count(*) AS n FROM x GROUP BY 1, 2""")
def acronym_expand(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "golden").select("qid", F.explode(X.tokens(F.col("question"), True)).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id)
SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM p) WHERE rank <= 30""")
def dense_topk(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "embeddings").select("vec_id", "embedding")
    return R.dense_topk(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), v, 30).withColumn("score", F.round("score", 6))


@query(f"""WITH {HITS}, k AS (SELECT *, CASE WHEN dense IS NOT NULL THEN row_number() OVER (PARTITION BY run_id, query_id ORDER BY dense DESC NULLS LAST, chunk_id) END AS dr, CASE WHEN sparse IS NOT NULL THEN row_number() OVER (PARTITION BY run_id, query_id ORDER BY sparse DESC NULLS LAST, chunk_id) END AS sr FROM h),
f AS (SELECT *, coalesce(1.0::DOUBLE / (60 + dr), 0) + coalesce(1.0::DOUBLE / (60 + sr), 0) AS fused FROM k) SELECT run_id, query_id, chunk_id, round(fused, 9) AS fused, CAST(row_number() OVER (PARTITION BY run_id, query_id ORDER BY round(fused, 9) DESC, chunk_id) AS INTEGER) AS fused_rank FROM f""")
def rrf_fusion(s: SparkSession, d: str) -> DataFrame:
    return R.reciprocal_rank_fusion(R.distinct_hits(table(s, d, "hits"))).select("run_id", "query_id", "chunk_id", F.round("fused", 9).alias("fused"), "fused_rank")


@query(f"WITH {NORM}, f AS (SELECT *, 0.2::DOUBLE * dn + 0.8::DOUBLE * sn AS fused FROM nm) SELECT run_id, query_id, chunk_id, round(dn, 6) AS dense_norm, round(sn, 6) AS sparse_norm, round(fused, 6) AS fused, CAST(row_number() OVER (PARTITION BY run_id, query_id ORDER BY round(fused, 9) DESC, chunk_id) AS INTEGER) AS fused_rank FROM f")
def weighted_fusion(s: SparkSession, d: str) -> DataFrame:
    return R.weighted_fusion(R.distinct_hits(table(s, d, "hits"))).select("run_id", "query_id", "chunk_id", *[F.round(c, 6).alias(c) for c in ("dense_norm", "sparse_norm", "fused")], "fused_rank")


@query(f"""WITH {NORM}, f AS (SELECT *, w.weight, w.weight * dn + (1 - w.weight) * sn AS fused FROM nm, (VALUES (0.0::DOUBLE), (0.2), (0.5), (0.8), (1.0)) w(weight)), k AS (SELECT *, row_number() OVER (PARTITION BY weight, run_id, query_id ORDER BY round(fused, 9) DESC, chunk_id) AS fr FROM f)
SELECT weight, count(*) AS n, count(*) FILTER (list_contains(gold_doc_ids, doc_id)) AS gold_in_top5 FROM k JOIN golden ON query_id = qid WHERE fr <= 5 GROUP BY 1""")
def weight_sweep(s: SparkSession, d: str) -> DataFrame:
    ranked = R.weight_sweep(R.distinct_hits(table(s, d, "hits")), [0.0, 0.2, 0.5, 0.8, 1.0]).where("fused_rank <= 5")
    gold = table(s, d, "golden").select(F.col("qid").alias("query_id"), "gold_doc_ids")
    return ranked.join(gold, "query_id").groupBy("weight").agg(F.count("*").alias("n"), F.count_if(F.array_contains("gold_doc_ids", F.col("doc_id"))).alias("gold_in_top5"))


@query(f"WITH {HITS}, c AS (SELECT *, row_number() OVER (PARTITION BY run_id, query_id, doc_id ORDER BY rank, chunk_id) AS n FROM h) SELECT run_id, query_id, chunk_id, doc_id, CAST(row_number() OVER (PARTITION BY run_id, query_id ORDER BY rank, chunk_id) AS INTEGER) AS rank FROM c WHERE n <= 2")
def cap_per_document(s: SparkSession, d: str) -> DataFrame:
    return R.cap_per_document(R.distinct_hits(table(s, d, "hits")), 2).select("run_id", "query_id", "chunk_id", "doc_id", "rank")


def _doc_hits(s: SparkSession, d: str) -> DataFrame:
    return R.dedupe_by_document(table(s, d, "hits"))


def _metrics(s: SparkSession, d: str) -> DataFrame:
    return E.retrieval_metrics(_doc_hits(s, d), table(s, d, "golden"))


@query(f"WITH {DOCS} SELECT * FROM d")
def dedupe_by_document(s: SparkSession, d: str) -> DataFrame:
    return _doc_hits(s, d)


@query(f"WITH {METRICS} SELECT * FROM m")
def retrieval_metrics(s: SparkSession, d: str) -> DataFrame:
    return _metrics(s, d)


@query(f"WITH {METRICS}, q AS (SELECT m.*, retrieval_challenge, stratum FROM m JOIN golden ON query_id = qid) SELECT retrieval_challenge, stratum, CAST(grouping(retrieval_challenge, stratum) AS INTEGER) AS level, count(*) AS n, round(avg(recall_5), 6) AS mean FROM q GROUP BY GROUPING SETS ((retrieval_challenge), (stratum), ())")
def metric_slices(s: SparkSession, d: str) -> DataFrame:
    return E.slices(_metrics(s, d), table(s, d, "golden"))


@query(f"WITH {METRICS} SELECT run_id, query_id, recall_5 FROM m ORDER BY recall_5, run_id, query_id LIMIT 20")
def worst_questions(s: SparkSession, d: str) -> DataFrame:
    return _metrics(s, d).select("run_id", "query_id", "recall_5").orderBy("recall_5", "run_id", "query_id").limit(20)


@query(f"WITH {METRICS} SELECT run_id, count(*) AS n, round(avg(rr), 6) AS mrr, round(avg(ap), 6) AS map, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(recall_5), 6) AS recall_5 FROM m GROUP BY 1")
def metrics_by_run(s: SparkSession, d: str) -> DataFrame:
    return _metrics(s, d).groupBy("run_id").agg(F.count("*").alias("n"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ap"), 6).alias("map"), F.round(F.avg("ndcg_10"), 6).alias("ndcg_10"), F.round(F.avg("recall_5"), 6).alias("recall_5"))


BOOT = """v AS (SELECT row_number() OVER (ORDER BY query_id) AS i, v, count(*) OVER () AS n FROM q), b AS (SELECT b, avg(v.v) AS m FROM range(200) t(b), (SELECT unnest(range(1, (SELECT count(*) FROM q) + 1)) AS d), v WHERE v.i = ((b * 7919 + d * 104729 + 42 * 1299709 + ((b * d) % 10007) * 15485863) % 2147483647) % v.n + 1 GROUP BY b),
o AS (SELECT m, row_number() OVER (ORDER BY m, b) AS r FROM b) SELECT round((SELECT avg(v) FROM v), 6) AS mean, round(max(CASE WHEN r = 5 THEN m END), 6) AS ci_low, round(max(CASE WHEN r = 195 THEN m END), 6) AS ci_high FROM o"""


def _recall(s: SparkSession, d: str) -> DataFrame:
    return _metrics(s, d).groupBy("query_id").agg(F.avg("recall_5").alias("v"))


def _gain(s: SparkSession, d: str) -> DataFrame:
    return _metrics(s, d).groupBy("query_id").agg(F.avg(F.col("recall_10") - F.col("recall_3")).alias("v"))


@query(f"WITH {METRICS}, q AS (SELECT query_id, avg(recall_5) AS v FROM m GROUP BY 1), {BOOT}")
def bootstrap_ci(s: SparkSession, d: str) -> DataFrame:
    return E.bootstrap(_recall(s, d), "query_id", "v", rounds=200)  # as many as its SQL has


@query(f"WITH {METRICS}, q AS (SELECT query_id, avg(recall_10 - recall_3) AS v FROM m GROUP BY 1), {BOOT}")
def paired_difference(s: SparkSession, d: str) -> DataFrame:
    return E.bootstrap(_gain(s, d), "query_id", "v", rounds=200)  # as many as its SQL has


# The whole job: 2000 resamples, and whether the difference is significant.
BOOT_2000 = BOOT.replace("range(200)", "range(2000)").replace("r = 5 ", "r = 50 ").replace("r = 195 ", "r = 1950 ")


@query(f"WITH {METRICS}, q AS (SELECT query_id, avg(recall_5) AS v FROM m GROUP BY 1), {BOOT_2000}")
def bootstrap_ci_2000(s: SparkSession, d: str) -> DataFrame:
    return E.bootstrap(_recall(s, d), "query_id", "v")


@query(f"SELECT *, ci_low > 0 OR ci_high < 0 AS significant FROM (WITH {METRICS}, q AS (SELECT query_id, avg(recall_10 - recall_3) AS v FROM m GROUP BY 1), {BOOT_2000})")
def paired_difference_2000(s: SparkSession, d: str) -> DataFrame:
    return E.paired_bootstrap(_gain(s, d), "query_id", "v")


def _confidence(s: SparkSession, d: str) -> DataFrame:
    return E.gate_confidence(E.confidence_signals(table(s, d, "hits").distinct()), table(s, d, "gate"))


def _labelled(s: SparkSession, d: str) -> DataFrame:
    gold = table(s, d, "golden").select(F.col("qid").alias("query_id"), (F.col("expected") == "answer").alias("answerable"))
    return _confidence(s, d).join(gold, "query_id").where("confidence is not null").select(F.round("confidence", 6).alias("confidence"), "answerable")


@query(f"WITH {SIGNALS} SELECT run_id, query_id, round(top_dense, 6) AS top_dense, round(mean_top3 + 1e-9, 6) AS mean_top3, round(top_sparse, 6) AS top_sparse, round(score_gap, 6) AS score_gap, n_matched FROM sg")
def confidence_signals(s: SparkSession, d: str) -> DataFrame:
    return E.confidence_signals(table(s, d, "hits").distinct()).select("run_id", "query_id", *[F.round(F.col(c) + (1e-9 if c == "mean_top3" else 0.0), 6).alias(c) for c in ("top_dense", "mean_top3", "top_sparse", "score_gap")], "n_matched")


@query(f"WITH {SIGNALS} SELECT run_id, query_id, round(confidence, 6) AS confidence, coalesce(round(confidence, 6) < -0.325, true) AS refused FROM cf")
def gate_decide(s: SparkSession, d: str) -> DataFrame:
    return E.decide(_confidence(s, d).withColumn("confidence", F.round("confidence", 6)), -0.325)


@query(f"WITH {SIGNALS} SELECT threshold, round(tr, 6) AS true_refusal, round(fr, 6) AS false_refusal, round((tr + 1 - fr) / 2, 6) AS balanced_accuracy FROM (SELECT threshold, count(*) FILTER (NOT answerable AND confidence < threshold) / count(*) FILTER (NOT answerable) AS tr, count(*) FILTER (answerable AND confidence < threshold) / count(*) FILTER (answerable) AS fr FROM lab, (SELECT unnest([-2.0::DOUBLE, -1.5, -1.0, -0.5, 0.0, 0.5, 1.0]) AS threshold) GROUP BY 1)")
def threshold_curve(s: SparkSession, d: str) -> DataFrame:
    return E.threshold_curve(_labelled(s, d), [-2.0, -1.5, -1.0, -0.5, 0.0, 0.5, 1.0])


@query(f"WITH {SIGNALS}, c AS (SELECT confidence, count(*) FILTER (answerable) AS p, count(*) FILTER (NOT answerable) AS n FROM lab GROUP BY 1), k AS (SELECT *, coalesce(sum(n) OVER (ORDER BY confidence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c) SELECT round((sum(p * (b + n / 2)) / (sum(p) * sum(n)))::DOUBLE, 6) AS auroc FROM k")
def auroc(s: SparkSession, d: str) -> DataFrame:
    return E.auroc(_labelled(s, d))


@query(f"WITH {SIGNALS} SELECT round((avg(CASE WHEN answerable THEN confidence END) - avg(CASE WHEN NOT answerable THEN confidence END)) / sqrt((var_pop(CASE WHEN answerable THEN confidence END) + var_pop(CASE WHEN NOT answerable THEN confidence END)) / 2), 6) AS cohens_d FROM lab")
def cohens_d(s: SparkSession, d: str) -> DataFrame:
    return E.cohens_d(_labelled(s, d))


def _papers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "papers")


@query(r"SELECT DISTINCT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g'), '^\s+|\s+$', '', 'g')) AS h FROM papers")
def normalize_whitespace(s: SparkSession, d: str) -> DataFrame:
    return _papers(s, d).select("doc_id", F.md5(X.normalize_whitespace(F.col("text"))).alias("h")).distinct()


@query(r"SELECT DISTINCT doc_id, CASE WHEN length(title) <= 40 THEN title ELSE regexp_replace(title[1:34], '\s+$', '', 'g') || ' [...]' END AS short FROM papers")
def truncate_titles(s: SparkSession, d: str) -> DataFrame:
    return _papers(s, d).select("doc_id", X.truncate(F.col("title"), 40).alias("short")).distinct()


@query(r"""WITH a AS (SELECT DISTINCT doc_id, regexp_replace(regexp_replace(text, '<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->', ' ', 'gsi'), '</?[a-zA-Z][^<>]*>', '', 'g') AS t FROM papers),
b AS (SELECT doc_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM a) SELECT DISTINCT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g'), '^\s+|\s+$', '', 'g')) AS h FROM b""")
def clean_markup(s: SparkSession, d: str) -> DataFrame:
    return _papers(s, d).select("doc_id", F.md5(X.clean_markup(F.col("text"))).alias("h")).distinct()


@query(f"SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS sentence FROM (SELECT doc_id, {sql_sentences('text')} AS l FROM papers)")
def sentence_lists(s: SparkSession, d: str) -> DataFrame:
    return _papers(s, d).select("doc_id", F.posexplode(X.split_sentences(F.col("text"))).alias("pos", "sentence"))


_NAMES = "|".join(sorted(X.SECTIONS, key=lambda x: (-len(x), x)))


@query(rf"""WITH m AS (SELECT doc_id, text, regexp_replace(text, '(?m)^#{{1,6}}[ \t]+(.+)$', chr(1) || '\1' || chr(2), 'g') AS md, regexp_replace(text, '(^|[.!?]\s*|\n)({_NAMES})(?::\s*|([A-Z]))', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g') AS plain FROM papers WHERE text IS NOT NULL),
p AS (SELECT doc_id, text, list_filter(string_split(CASE WHEN contains(md, chr(1)) THEN md ELSE plain END, chr(1)), lambda x: contains(x, chr(2))) AS l FROM m),
e AS (SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS x FROM p)
SELECT doc_id, pos, array_to_string(list_transform(string_split(lower(regexp_replace(string_split(x, chr(2))[1], '^\s+|\s+$', '', 'g')), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS heading, regexp_replace(string_split(x, chr(2))[-1], '^\s+|\s+$', '', 'g') AS body FROM e
UNION ALL SELECT doc_id, 0, 'Abstract', text FROM p WHERE len(l) = 0""")
def parsed_sections(s: SparkSession, d: str) -> DataFrame:
    return _papers(s, d).select("doc_id", F.explode(X.sections_of(F.col("text"))).alias("c")).select("doc_id", "c.*")


@query()
def chunk_documents(s: SparkSession, d: str) -> DataFrame:
    return C.chunk_documents(_papers(s, d))


@query("""SELECT count(*) AS n_chunks, count(DISTINCT doc_id) AS n_documents, count(DISTINCT (doc_id, section)) AS n_sections, round(avg(length(text)), 6) AS mean_chars, CAST(min(length(text)) AS INTEGER) AS min_chars, CAST(max(length(text)) AS INTEGER) AS max_chars,
(SELECT n[CAST(len(n) // 2 + 1 AS INTEGER)] FROM (SELECT list(CAST(length(text) AS INTEGER) ORDER BY length(text)) AS n FROM chunks WHERE text IS NOT NULL)) AS median_chars FROM chunks""")
def chunk_stats(s: SparkSession, d: str) -> DataFrame:
    return C.chunk_stats(table(s, d, "chunks"))


@query()
def chunk_stats_of_papers(s: SparkSession, d: str) -> DataFrame:
    return C.chunk_stats(C.chunk_documents(_papers(s, d).dropDuplicates(["doc_id"])))


@query(r"""WITH k AS (SELECT doc_id, coalesce(length(text), 0) AS n, nullif(lower(regexp_replace(regexp_replace(doi, '^\s+|\s+$', '', 'g'), '^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)', '', 'i')), '') AS d, nullif(lower(regexp_replace(regexp_replace(title, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')), '') AS t FROM papers),
r AS (SELECT coalesce('doi:' || d, 'title:' || t, 'id:' || doc_id) AS key, doc_id, n FROM k) SELECT key, doc_id, CAST(n AS INTEGER) AS n_chars, records FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, doc_id) AS i, count(*) OVER (PARTITION BY key) AS records FROM r) WHERE i = 1""")
def dedupe_documents(s: SparkSession, d: str) -> DataFrame:
    return C.dedupe_documents(_papers(s, d))


@query(r"SELECT action, stratum, count(*) AS n FROM (SELECT stratum, CASE WHEN length(coalesce(regexp_replace(text, '^\s+|\s+$', '', 'g'), '')) >= 250 THEN 'keep' WHEN coalesce(list_contains(tags, 'pinned'), false) OR coalesce(source IN ('crossref', 'author_supplied'), false) THEN 'stub' ELSE 'drop' END AS action FROM papers) GROUP BY 1, 2")
def keep_stub_drop(s: SparkSession, d: str) -> DataFrame:
    return C.keep_action(_papers(s, d)).groupBy("action", "stratum").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS n_documents, min(CASE WHEN year <> 0 THEN year END) AS year_min, max(CASE WHEN year <> 0 THEN year END) AS year_max, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS chars, count(*) FILTER (len(sections) > 1) AS n_with_sections, count(*) FILTER (doi <> '') AS n_with_doi, count(*) FILTER (len(authors) > 0) AS n_with_authors,
(SELECT n[CAST(len(n) // 2 + 1 AS INTEGER)] FROM (SELECT list(CAST(coalesce(length(text), 0) AS INTEGER) ORDER BY length(text) NULLS FIRST) AS n FROM papers)) AS median FROM papers""")
def corpus_summary(s: SparkSession, d: str) -> DataFrame:
    p = _papers(s, d).withColumn("len", F.coalesce(F.length("text"), F.lit(0)))
    year = F.when(F.col("year") != 0, F.col("year"))
    stats = p.agg(F.count("*").alias("n_documents"), F.min(year).alias("year_min"), F.max(year).alias("year_max"), F.sum("len").alias("chars"), F.count_if(F.size("sections") > 1).alias("n_with_sections"), F.count_if(F.col("doi") != "").alias("n_with_doi"), F.count_if(F.size("authors") > 0).alias("n_with_authors"))
    return stats.crossJoin(C.upper_median(p, "len"))  # one row each


@query("SELECT stratum, source, topic, CAST(grouping(stratum, source, topic) AS INTEGER) AS level, count(*) AS n FROM papers GROUP BY GROUPING SETS ((stratum), (source), (topic))")
def corpus_counts(s: SparkSession, d: str) -> DataFrame:
    return _papers(s, d).groupingSets([["stratum"], ["source"], ["topic"]], "stratum", "source", "topic").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"))


@query("SELECT DISTINCT doc_id, CASE WHEN coalesce(len(k), 0) = 0 THEN 'Unknown' ELSE array_to_string(k[1:3], ', ') || CASE WHEN len(k) > 3 THEN ' et al.' ELSE '' END END AS authors, coalesce(CAST(nullif(year, 0) AS VARCHAR), 'n.d.') AS year, coalesce(nullif(url, ''), 'https://doi.org/' || doi) AS url, substr(sha256(concat_ws(chr(31), doc_id, title)), 1, 16) AS hash FROM (SELECT *, list_filter(authors, lambda a: a IS NOT NULL) AS k FROM papers)")
def citation_fields(s: SparkSession, d: str) -> DataFrame:
    p = _papers(s, d)
    return p.select("doc_id", X.author_list(F.col("authors")).alias("authors"), F.coalesce(F.nullif("year", F.lit(0)).cast("string"), F.lit("n.d.")).alias("year"), F.coalesce(F.nullif("url", F.lit("")), F.concat(F.lit("https://doi.org/"), "doi")).alias("url"), X.stable_hash(F.col("doc_id"), F.col("title")).alias("hash")).distinct()


@query("SELECT topic, stratum, count(*) AS fetches, CAST(sum(fetched) AS BIGINT) AS fetched, count(error) AS failed FROM (SELECT DISTINCT * FROM fetch_audit) GROUP BY 1, 2")
def fetch_audit_summary(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "fetch_audit").distinct().groupBy("topic", "stratum").agg(F.count("*").alias("fetches"), F.sum("fetched").alias("fetched"), F.count("error").alias("failed"))


@query(r"""WITH g AS (SELECT *, lower(coalesce(regexp_replace(question, '^\s+|\s+$', '', 'g'), '')) AS q, coalesce(qid, '<no qid>') AS id, coalesce(expected = 'answer', false) AS ans FROM golden), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY id, question) AS a, row_number() OVER (PARTITION BY q ORDER BY id, question) AS b FROM g)
SELECT id AS qid, 'duplicate_qid' AS rule FROM n WHERE a > 1 UNION ALL SELECT id, 'empty_question' FROM n WHERE q = '' UNION ALL SELECT id, 'duplicate_question' FROM n WHERE b > 1 AND q <> ''
UNION ALL SELECT id, 'stratum' FROM n WHERE NOT coalesce(stratum IN ('clinical', 'methods', 'rag'), false) UNION ALL SELECT id, 'category' FROM n WHERE NOT coalesce(category IN ('methodological', 'factual', 'numeric', 'comparative', 'definitional', 'multi_hop', 'bibliographic', 'own_work'), false)
UNION ALL SELECT id, 'no_gold' FROM n WHERE ans AND coalesce(len(gold_doc_ids), 0) = 0 UNION ALL SELECT id, 'no_answer_points' FROM n WHERE ans AND coalesce(len(answer_points), 0) = 0 UNION ALL SELECT id, 'challenge' FROM n WHERE ans AND NOT coalesce(retrieval_challenge IN ('semantic', 'lexical', 'both', 'none'), false)
UNION ALL SELECT id, 'difficulty' FROM n WHERE ans AND NOT coalesce(difficulty IN ('easy', 'medium', 'hard'), false) UNION ALL SELECT id, 'no_proof' FROM n WHERE NOT ans AND coalesce(len(absent_terms), 0) = 0 AND coalesce(len(must_not_cooccur), 0) = 0
UNION ALL SELECT id, 'unknown_gold' FROM (SELECT id, unnest(gold_doc_ids) AS doc_id FROM n WHERE ans) x WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM papers WHERE doc_id IS NOT NULL)""")
def golden_errors(s: SparkSession, d: str) -> DataFrame:
    return C.golden_errors(table(s, d, "golden"), _papers(s, d))


@query("SELECT DISTINCT qid, question AS term FROM golden JOIN papers ON contains(lower(concat_ws(' ', title, text)), lower(question))")
def verbatim_questions(s: SparkSession, d: str) -> DataFrame:
    return C.contained(table(s, d, "golden").select("qid", F.col("question").alias("term")), _papers(s, d))


@query("SELECT DISTINCT qid, term FROM (SELECT qid, unnest(absent_terms) AS term FROM golden) JOIN papers ON contains(lower(concat_ws(' ', title, text)), lower(term))")
def absent_terms(s: SparkSession, d: str) -> DataFrame:
    return C.contained(table(s, d, "golden").select("qid", F.explode("absent_terms").alias("term")), _papers(s, d))


COOCCUR = "SELECT qid, terms, count(*) AS n, min(doc_id) AS doc_id FROM (SELECT DISTINCT * FROM g) g JOIN (SELECT DISTINCT doc_id, title, text, lower(concat_ws(' ', title, text)) AS t FROM papers) p ON len(terms) > 0 AND len(list_filter(terms, lambda x: x IS NULL OR NOT contains(t, lower(x)))) = 0 GROUP BY 1, 2"


@query(f"WITH g AS (SELECT qid, unnest(must_not_cooccur) AS terms FROM golden) {COOCCUR}")
def cooccurrences(s: SparkSession, d: str) -> DataFrame:
    return C.cooccurrences(table(s, d, "golden").select("qid", F.explode("must_not_cooccur").alias("terms")), _papers(s, d))


@query(rf"WITH g AS (SELECT qid, regexp_extract_all(question, '[A-Za-z]+')[1:3] AS terms FROM golden) {COOCCUR}")
def first_words_cooccur(s: SparkSession, d: str) -> DataFrame:
    """The same on groups that do occur: the first three words of each question."""
    return C.cooccurrences(table(s, d, "golden").select("qid", F.slice(F.regexp_extract_all("question", F.lit("([A-Za-z]+)"), 1), 1, 3).alias("terms")), _papers(s, d))


@query("SELECT field, value, count(*) AS n FROM (SELECT 'category' AS field, category AS value FROM golden UNION ALL SELECT 'stratum', stratum FROM golden UNION ALL SELECT 'expected', expected FROM golden UNION ALL SELECT 'difficulty', difficulty FROM golden WHERE difficulty IS NOT NULL UNION ALL SELECT 'retrieval_challenge', retrieval_challenge FROM golden WHERE retrieval_challenge IS NOT NULL) GROUP BY 1, 2")
def golden_composition(s: SparkSession, d: str) -> DataFrame:
    return C.composition(table(s, d, "golden"))


PASSAGES = "pas AS (SELECT qid, rank, text FROM top JOIN (SELECT chunk_id, min(text) AS text FROM chunks GROUP BY 1) USING (chunk_id) WHERE rank <= 6)"
EXTRACTED = f"""{TOKENS}, {BM25.format(post='post')}, {PASSAGES},
qt AS (SELECT qid, list_distinct({sql_tokens('question')}) AS terms FROM golden),
sen AS (SELECT qid, rank, unnest(range(len(l))) AS pos, unnest(l) AS s FROM (SELECT qid, rank, {sql_sentences('text')} AS l FROM pas)),
ov AS (SELECT qid, rank, pos, s, len(list_intersect(list_distinct(regexp_extract_all(lower(s), '([\\p{{L}}\\p{{N}}]+)', 1)), terms)) AS o FROM sen JOIN qt USING (qid)),
bs AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY o DESC, rank, pos) AS n FROM ov WHERE o > 0),
ans AS (SELECT g.qid, coalesce(a.answer, 'INSUFFICIENT_CONTEXT') AS answer FROM (SELECT DISTINCT qid FROM golden) g LEFT JOIN (SELECT qid, string_agg(s || ' [' || rank || ']', ' ' ORDER BY n) AS answer FROM bs WHERE n <= 3 GROUP BY 1) a USING (qid))"""


def _passages(s: SparkSession, d: str) -> DataFrame:
    hits = R.bm25(table(s, d, "golden"), _post(s, d), 6)
    return hits.join(table(s, d, "chunks").groupBy("chunk_id").agg(F.min("text").alias("text")), "chunk_id").select("qid", "rank", "text")


def _extracted(s: SparkSession, d: str, passages: DataFrame) -> DataFrame:
    asked = table(s, d, "golden").select("qid", F.array_distinct(X.tokens(F.col("question"))).alias("terms"))
    return C.extractive_answers(asked, passages)


@query(f"WITH {EXTRACTED} SELECT * FROM ans")
def extractive_answers(s: SparkSession, d: str) -> DataFrame:
    return _extracted(s, d, _passages(s, d))


@query("SELECT query_id AS qid, round(avg(CASE WHEN list_contains(gold_doc_ids, h.doc_id) THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS context_precision, count(DISTINCT h.doc_id) AS docs FROM (SELECT DISTINCT query_id, doc_id FROM hits) h JOIN golden ON query_id = qid WHERE len(gold_doc_ids) > 0 GROUP BY 1")
def context_precision(s: SparkSession, d: str) -> DataFrame:
    golden = table(s, d, "golden").where(F.size("gold_doc_ids") > 0).select("qid", "gold_doc_ids")
    pairs = table(s, d, "hits").select(F.col("query_id").alias("qid"), "doc_id").distinct().join(golden, "qid")
    gold = F.when(F.array_contains("gold_doc_ids", F.col("doc_id")), 1.0).otherwise(0.0)
    return pairs.groupBy("qid").agg(F.round(F.avg(gold), 6).alias("context_precision"), F.count("doc_id").alias("docs"))


ANSWERS = """a AS (SELECT run_id, query_id, concat('Found ', count(DISTINCT chunk_id), ' passages [1]. The best are near [2, ', 3 + run_id % 4, ']. No source says more. See also [', 9 + run_id % 5, ', 1].') AS answer FROM hits GROUP BY 1, 2),
mk AS (SELECT DISTINCT run_id, query_id, CAST(trim(unnest(string_split(g, ','))) AS INTEGER) AS marker FROM (SELECT run_id, query_id, unnest(regexp_extract_all(answer, '\\[([0-9]+(?:\\s*,\\s*[0-9]+)*)\\]', 1)) AS g FROM a)),
rk AS (SELECT run_id, query_id, rank AS marker, min(doc_id) AS doc_id FROM hits GROUP BY 1, 2, 3)"""


def _answers(s: SparkSession, d: str) -> DataFrame:
    """Answers with markers, some of them fabricated, made from the hits."""
    text = F.concat(F.lit("Found "), F.countDistinct("chunk_id").cast("string"), F.lit(" passages [1]. The best are near [2, "), (3 + F.col("run_id") % 4).cast("string"), F.lit("]. No source says more. See also ["), (9 + F.col("run_id") % 5).cast("string"), F.lit(", 1]."))
    return table(s, d, "hits").groupBy("run_id", "query_id").agg(text.alias("answer"))


@query(f"WITH {ANSWERS} SELECT * FROM mk")
def citation_markers(s: SparkSession, d: str) -> DataFrame:
    return A.cited(_answers(s, d))


@query(f"WITH {ANSWERS} SELECT run_id, query_id, marker, doc_id FROM mk JOIN rk USING (run_id, query_id, marker)")
def resolve_citations(s: SparkSession, d: str) -> DataFrame:
    return A.resolve_citations(_answers(s, d), table(s, d, "hits"))[0].select("run_id", "query_id", "marker", "doc_id")


@query(f"WITH {ANSWERS} SELECT run_id, query_id, marker FROM mk ANTI JOIN rk USING (run_id, query_id, marker)")
def fabricated_markers(s: SparkSession, d: str) -> DataFrame:
    return A.resolve_citations(_answers(s, d), table(s, d, "hits"))[1].select("run_id", "query_id", "marker")


@query(f"""WITH {ANSWERS} SELECT run_id, query_id, citation_coverage, unique_sources, fabricated, passages_supplied FROM (SELECT run_id, query_id, count(DISTINCT doc_id) AS unique_sources, count(*) FILTER (rk.marker IS NULL) AS fabricated FROM mk LEFT JOIN rk USING (run_id, query_id, marker) GROUP BY 1, 2)
    JOIN (SELECT run_id, query_id, round(avg(CASE WHEN regexp_matches(x, '\\[[0-9]') THEN 1.0::DOUBLE ELSE 0 END), 6) AS citation_coverage FROM (SELECT run_id, query_id, unnest({sql_claims('answer')}) AS x FROM a) GROUP BY 1, 2) USING (run_id, query_id)
    JOIN (SELECT run_id, query_id, count(DISTINCT rank) AS passages_supplied FROM hits GROUP BY 1, 2) USING (run_id, query_id)""")
def citation_audit(s: SparkSession, d: str) -> DataFrame:
    return A.audit(_answers(s, d), table(s, d, "hits"))


@query(f"WITH {ANSWERS} SELECT run_id, query_id, round(avg(CASE WHEN coalesce(list_contains(gold_doc_ids, doc_id), false) THEN 1.0::DOUBLE ELSE 0 END), 6) AS citation_accuracy FROM mk JOIN rk USING (run_id, query_id, marker) JOIN golden ON query_id = qid GROUP BY 1, 2")
def citation_accuracy(s: SparkSession, d: str) -> DataFrame:
    return A.citation_accuracy(A.resolve_citations(_answers(s, d), table(s, d, "hits"))[0], table(s, d, "golden"))


@query("WITH p AS (SELECT DISTINCT qid, note, unnest(answer_points) AS point FROM golden) SELECT qid, round(avg(CASE WHEN coalesce(contains(lower(note), lower(point)), false) THEN 1.0::DOUBLE ELSE 0 END), 6) AS correctness, list_sort(coalesce(list(point) FILTER (NOT coalesce(contains(lower(note), lower(point)), false)), [])) AS missing FROM p WHERE point IS NOT NULL GROUP BY 1")
def answer_correctness(s: SparkSession, d: str) -> DataFrame:
    golden = table(s, d, "golden")
    return A.answer_correctness(golden.select("qid", "note"), golden, "note")


@query(f"WITH {SIGNALS}, x AS (SELECT query_id, coalesce(round(confidence, 6) < -0.325, true) AS r, expected = 'answer' AS a FROM cf JOIN golden ON query_id = qid) SELECT count(*) AS n, count(*) FILTER (r) AS refused, round(avg(CASE WHEN a <> r THEN 1.0::DOUBLE ELSE 0 END), 6) AS refusal_accuracy, count(*) FILTER (NOT a AND NOT r) AS incorrectly_answered, count(*) FILTER (a AND r) AS over_refused, coalesce(list_sort(list(DISTINCT query_id) FILTER (a AND r)), []) AS over_refused_qids FROM x")
def refusal_block(s: SparkSession, d: str) -> DataFrame:
    return A.refusal_block(E.decide(_confidence(s, d).withColumn("confidence", F.round("confidence", 6)), -0.325), table(s, d, "golden"))


@query(f"WITH {TOKENS}, {BM25.format(post='post')}, w AS (SELECT qid, rank, text, sum(length(text)) OVER (PARTITION BY qid ORDER BY rank) AS n FROM top JOIN (SELECT chunk_id, min(text) AS text FROM chunks GROUP BY 1) USING (chunk_id) WHERE rank <= 6), c AS (SELECT qid, string_agg('[' || rank || '] ' || text, E'\n' ORDER BY rank) AS context FROM w WHERE n <= 2200 GROUP BY 1) SELECT qid, md5('QUESTION: ' || question || E'\nCONTEXT:\n' || coalesce(context, '')) AS prompt FROM golden LEFT JOIN c USING (qid)")
def prompt_assembly(s: SparkSession, d: str) -> DataFrame:
    golden = table(s, d, "golden")
    hits = R.bm25(golden, _post(s, d), 6).join(table(s, d, "chunks").groupBy("chunk_id").agg(F.min("text").alias("text")), "chunk_id")
    return A.prompts(golden.select("qid", "question"), hits.select("qid", "rank", "text")).withColumn("prompt", F.md5("prompt"))


@query(f"""WITH {EXTRACTED}, cl AS (SELECT qid, unnest(range(len(l))) AS pos, unnest(l) AS claim FROM (SELECT qid, {sql_claims('answer')} AS l FROM ans)),
cw AS (SELECT qid, pos, claim, {sql_words('claim')} AS w FROM cl), sh AS (SELECT qid, pos, max(claim) AS claim, coalesce(max(len(list_intersect(w, pw)) / len(w)), 0) AS share FROM cw LEFT JOIN (SELECT qid, {sql_words('text')} AS pw FROM pas) USING (qid) WHERE len(w) > 0 GROUP BY 1, 2)
SELECT qid, round(avg((share >= 0.6)::INTEGER), 6) AS faithfulness, round(1 - avg((share >= 0.6)::INTEGER), 6) AS hallucination, count(*) FILTER (share >= 0.6) AS n_supported, count(*) AS n_sentences, coalesce(list(claim ORDER BY pos) FILTER (share < 0.6), []) AS unsupported FROM sh GROUP BY 1""")
def faithfulness(s: SparkSession, d: str) -> DataFrame:
    passages = _passages(s, d)
    return A.faithfulness(_extracted(s, d, passages), passages)


@query()
def signal_subsets(s: SparkSession, d: str) -> DataFrame:
    """Every non-empty subset of signals with the best of all thresholds; ties fall to fewer signals."""
    signals = E.confidence_signals(table(s, d, "hits").distinct()).withColumnRenamed("query_id", "qid").join(table(s, d, "golden").select("qid", (F.col("expected") == "answer").alias("answerable")), "qid")
    return E.select_signals(signals, ["top_dense", "mean_top3", "top_sparse", "score_gap", "n_matched"], grid=None)
