"""Sparse and dense retrieval, fusion and caps over batches of questions.

Postings are joined on terms; statistics always cover the unfiltered index; filters are placed below
scoring. Every ranked table carries an explicit rank; ties fall to the lesser id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import tokens
from folio.session import materialize

K1, B, RRF_K, DENSE_WEIGHT = 1.5, 0.75, 60, 0.2
LEXICAL_DIM = 256
QUERY_VALUES = 8_000_000  # numbers of one block of question vectors, 64 MB


def index_text(header: bool) -> Column:
    """The text that is indexed: with the header before it, or alone."""
    return F.concat_ws("\n", "header", "text") if header else F.col("text")


def chunk_filter(filters: dict | None) -> Column | None:
    """One condition on chunks from ``strata``, ``sections`` (lists), ``year_min``, ``year_max`` (inclusive; a null year
    fails) and ``contains`` (a text or a list; all must occur, without regard to case). Keys that are absent, null or
    empty and unknown keys ask for nothing; without any condition the result is None."""
    filters = filters or {}
    found = []
    for key, column in (("strata", "doc_stratum"), ("sections", "section")):
        if filters.get(key):
            found.append(F.col(column).isin(list(filters[key])))
    if filters.get("year_min") is not None:
        found.append(F.col("doc_year") >= int(filters["year_min"]))
    if filters.get("year_max") is not None:
        found.append(F.col("doc_year") <= int(filters["year_max"]))
    wanted = filters.get("contains") or []
    for term in [wanted] if isinstance(wanted, str) else wanted:
        found.append(F.contains(F.lower("text"), F.lower(F.lit(term))))
    if not found:
        return None
    out = found[0]
    for c in found[1:]:
        out = out & c
    return out


def filter_chunks(chunks: DataFrame, filters: dict | None) -> DataFrame:
    """The chunks that meet the filters; all of them without filters."""
    condition = chunk_filter(filters)
    return chunks if condition is None else chunks.where(condition)


def encode_lexical(rows: DataFrame, id_col: str, text_col: str, dim: int = LEXICAL_DIM, expand: bool = False) -> DataFrame:
    """``id_col``, ``embedding``: term counts hashed to ``dim`` places, of unit length; the offline encoder. Texts without
    terms have none; repeated rows count once."""
    known: dict[str, int] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for terms in batch.column(1).to_pylist():
                v = np.zeros(dim)
                for t in terms:
                    if t not in known:
                        if len(known) > 1_000_000:
                            known.clear()
                        known[t] = int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim
                    v[known[t]] += 1
                out.append((v / np.sqrt(v @ v)).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], [id_col, "embedding"])

    once = rows.select(id_col, F.col(text_col).alias("t")).where(F.col(id_col).isNotNull()).distinct()
    split = once.select(id_col, tokens(F.col("t"), expand).alias("terms")).where(F.size("terms") > 0)
    kind = rows.schema[id_col].dataType.simpleString()
    return split.mapInArrow(run, f"{id_col} {kind}, embedding array<double>")


def postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", expand: bool = False) -> DataFrame:
    """``id_col``, term, tf, dl. Repeated chunks count once; null and empty texts have none."""
    once = chunks.select(id_col, text_col).where(F.col(id_col).isNotNull()).distinct()
    flat = once.select(id_col, tokens(F.col(text_col), expand).alias("t")).select(id_col, F.size("t").alias("dl"), F.explode("t").alias("term"))
    return flat.groupBy(id_col, "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))


def index_stats(post: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """One row: n, avgdl, terms."""
    lengths = post.groupBy(id_col).agg(F.max("dl").alias("dl"))
    return lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).crossJoin(post.agg(F.countDistinct("term").alias("terms")))  # one row each


def idf(post: DataFrame, stats: DataFrame) -> DataFrame:
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    n = F.col("n")
    return df.crossJoin(F.broadcast(stats.select("n"))).select("term", "df", F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # one row


def top_k(scored: DataFrame, k: int, by: list[str], score: str = "score", tie: str = "chunk_id") -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(F.round(score, 9)), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25(questions: DataFrame, post: DataFrame, k: int, keep: DataFrame | None = None, qid: str = "qid", text: str = "question", expand: bool = False) -> DataFrame:
    """Top ``k`` chunks of each question: qid, chunk_id, rank, score, matched_terms. ``keep`` (chunk_id)
    restricts the chunks before scoring; the statistics stay those of the whole index."""
    post = post if hasattr(post, "_folio_path") else materialize(post, "postings")  # read four times below
    stats = index_stats(post)
    asked = questions.select(qid, F.explode(F.array_distinct(tokens(F.col(text), expand))).alias("term")).distinct()
    live = post.join(keep.select("chunk_id").distinct(), "chunk_id", "left_semi") if keep is not None else post
    # a posting's part of the score does not depend on the question: it is computed once, below the join
    used = idf(post, stats).join(asked.select("term").distinct(), "term", "left_semi")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weights = live.join(used, "term").crossJoin(F.broadcast(stats.select("avgdl"))).select("term", "chunk_id", part.alias("w"))  # one row
    best = top_k(weights.join(asked, "term").groupBy(qid, "chunk_id").agg(F.sum("w").alias("score")), k, [qid])
    # terms are gathered for the chunks that are returned only
    terms = best.select(qid, "chunk_id").join(asked, qid).join(live.select("chunk_id", "term"), ["chunk_id", "term"])
    matched = terms.groupBy(qid, "chunk_id").agg(F.array_sort(F.collect_set("term")).alias("matched_terms"))
    return best.join(matched, [qid, "chunk_id"]).select(qid, "chunk_id", "score", "matched_terms", "rank")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _nearest(ids: list, unit: np.ndarray, k: int, exclude_same: bool):
    """A function of Arrow batches (id, embedding): the best ``k`` of each batch for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, v) for i, v in enumerate(batch.column(1).to_pylist()) if v is not None and len(v) == unit.shape[1]]
            if not rows:
                continue
            matrix = np.array([v for _, v in rows], np.float64)
            length = np.sqrt((matrix * matrix).sum(axis=1))
            own = batch.column(0).take(pa.array([i for i, _ in rows]))
            names = own.to_pylist()
            order = np.argsort(np.argsort(np.array(names, dtype=object if isinstance(names[0], str) else None), kind="stable"), kind="stable")
            score = (matrix @ unit.T) / np.where(length > 0, length, np.nan)[:, None]
            q, at, value = [], [], []
            for j, name in enumerate(ids):
                s = np.round(score[:, j], 9)
                good = np.flatnonzero(~np.isnan(s))
                if exclude_same:
                    good = np.array([g for g in good if names[g] != name], np.int64)
                best = good[np.lexsort((order[good], -s[good]))[:k]]
                q += [name] * len(best)
                at += best.tolist()
                value += score[best, j].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(q, own.type if exclude_same else None), own.take(pa.array(at, pa.int64())), pa.array(value, pa.float64())], ["query_id", "vec_id", "score"])

    return run


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, exclude_same: bool = True) -> DataFrame:
    """Exact nearest neighbours of a stated query set: (query_id, q) against (vec_id, embedding), by cosine. Vectors are
    normalised once and multiplied batch by batch, each batch cut to ``k`` a question before the exchange. The query
    set is sent in blocks of ``QUERY_VALUES`` numbers, each block reading the vectors once. Null, empty and zero vectors and
    those of another length have no neighbours; repeated ids of one vector count once."""
    asked = [(r.query_id, r.q) for r in queries.where("query_id is not null and q is not null").dropDuplicates(["query_id"]).collect()]
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {vectors.schema['vec_id'].dataType.simpleString()}, score double"
    narrow = vectors.where("vec_id is not null").select("vec_id", "embedding").distinct()
    by_length: dict[int, list] = {}
    for name, q in asked:
        v = np.array(q, np.float64)
        if len(v) and np.isfinite(v).all() and v @ v > 0:
            by_length.setdefault(len(v), []).append((name, v / np.sqrt(v @ v)))
    found = None
    for length, rows in by_length.items():
        step = max(1, QUERY_VALUES // length)
        for at in range(0, len(rows), step):
            block = rows[at : at + step]
            part = narrow.mapInArrow(_nearest([n for n, _ in block], np.array([v for _, v in block]), k, exclude_same), kinds)
            found = part if found is None else found.union(part)
    if found is None:
        found = queries.sparkSession.createDataFrame([], kinds)
    return top_k(found, k, ["query_id"], tie="vec_id")


def distinct_hits(hits: DataFrame) -> DataFrame:
    """One row for each (run_id, query_id, chunk_id): its best channel scores."""
    return hits.groupBy("run_id", "query_id", "chunk_id").agg(F.min("doc_id").alias("doc_id"), F.min("rank").alias("rank"), F.max("dense").alias("dense"), F.max("sparse").alias("sparse"))


_Q = ["run_id", "query_id"]


def reciprocal_rank_fusion(hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) over the channels in which a chunk has a score."""
    ranked = hits
    for channel in ("dense", "sparse"):
        order = Window.partitionBy(*_Q).orderBy(F.desc_nulls_last(F.round(channel, 9)), "chunk_id")
        ranked = ranked.withColumn(f"{channel}_rank", F.when(F.col(channel).isNotNull(), F.row_number().over(order)))
    one = lambda c: F.coalesce(1.0 / (k + F.col(f"{c}_rank")), F.lit(0.0))
    fused = ranked.withColumn("fused", one("dense") + one("sparse"))
    return fused.withColumn("fused_rank", F.row_number().over(Window.partitionBy(*_Q).orderBy(F.desc(F.round("fused", 9)), "chunk_id")))


def min_max(hits: DataFrame) -> DataFrame:
    """Adds dense_norm and sparse_norm, scaled per question; missing scores 0, a zero range 1."""
    w = Window.partitionBy(*_Q)
    for c in ("dense", "sparse"):
        low, high = F.min(c).over(w), F.max(c).over(w)
        hits = hits.withColumn(f"{c}_norm", F.when(F.col(c).isNull(), 0.0).when(high == low, 1.0).otherwise((F.col(c) - low) / (high - low)))
    return hits


def weighted_fusion(hits: DataFrame, weight: float | Column = DENSE_WEIGHT, by: tuple[str, ...] = ()) -> DataFrame:
    """``weight`` * dense_norm + (1 - ``weight``) * sparse_norm, ranked per question (and ``by``)."""
    w = F.lit(weight) if isinstance(weight, float) else weight
    scored = (hits if "dense_norm" in hits.columns else min_max(hits)).withColumn("fused", w * F.col("dense_norm") + (1 - w) * F.col("sparse_norm"))
    return scored.withColumn("fused_rank", F.row_number().over(Window.partitionBy(*by, *_Q).orderBy(F.desc(F.round("fused", 9)), "chunk_id")))


def weight_sweep(hits: DataFrame, weights: list[float]) -> DataFrame:
    """All weights in one plan: the grid is exploded beside each normalised hit, not joined."""
    grid = F.explode(F.array(*map(F.lit, weights))).alias("weight")
    return weighted_fusion(min_max(hits).select("*", grid), F.col("weight"), ("weight",))


def cap_per_document(ranked: DataFrame, n: int, rank: str = "rank", by: tuple[str, ...] = tuple(_Q)) -> DataFrame:
    """At most ``n`` chunks of a document, order kept, ranks renewed; 0 disables."""
    if n <= 0:
        return ranked
    seen = F.row_number().over(Window.partitionBy(*by, "doc_id").orderBy(rank, "chunk_id"))
    kept = ranked.withColumn("__n", seen).where(F.col("__n") <= n).drop("__n")
    return kept.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(rank, "chunk_id")))


def rerank(ranked: DataFrame, score: Column, first: int = 30, rank: str = "rank", by: tuple[str, ...] = tuple(_Q)) -> DataFrame:
    """The ``first`` hits of a question in the order of ``score`` (greater first, null ones last), the others after them as
    they were. ``score`` may be a Pandas UDF; it is asked for the first hits only. Equal scores keep their order, so a
    constant score changes nothing."""
    scored = ranked.withColumn("__s", F.when(F.col(rank) <= first, score))
    order = Window.partitionBy(*by).orderBy((F.col(rank) > first).cast("int"), F.desc_nulls_last("__s"), rank, "chunk_id")
    return scored.withColumn(rank, F.row_number().over(order)).drop("__s")


def trace(ranked: DataFrame, mode: str = "weighted") -> DataFrame:
    """What a rank rests on: the raw and the scaled channel scores, the terms in common and the score that was used."""
    used = {"weighted": "fused", "hybrid": "fused", "dense": "dense", "sparse": "sparse"}[mode]
    return ranked.select(*_Q, "rank", "chunk_id", "doc_id", "dense", "sparse", "dense_norm", "sparse_norm", "fused", "matched_terms", F.lit(used).alias("used"), F.col(used).alias("score_used"))


def dedupe_by_document(ranked: DataFrame, rank: str = "rank", by: tuple[str, ...] = tuple(_Q)) -> DataFrame:
    """The first hit of each document, ranks renewed 1..n."""
    first = ranked.groupBy(*by, "doc_id").agg(F.min(rank).alias("__r"))
    return first.withColumn("doc_rank", F.row_number().over(Window.partitionBy(*by).orderBy("__r", "doc_id"))).drop("__r")
