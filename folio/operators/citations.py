"""Markers, citations, audits and answer metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import author_list, claims, landing_url, markers, split_sentences

REFUSAL = "INSUFFICIENT_CONTEXT"
_Q = ["run_id", "query_id"]


def refusal_detected(answer: F.Column) -> F.Column:
    return F.coalesce(F.contains(answer, F.lit(REFUSAL)), F.lit(False))


def cited(answers: DataFrame) -> DataFrame:
    """One row for each distinct marker of an answer."""
    return answers.select(*_Q, F.explode(markers(F.col("answer"))).alias("marker"))


def resolve_citations(answers: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Citations (markers that are a hit's rank, with its document) and fabricated markers."""
    ranks = hits.groupBy(*_Q, F.col("rank").alias("marker")).agg(F.min("doc_id").alias("doc_id"))
    found = cited(answers)
    return found.join(ranks, [*_Q, "marker"]), found.join(ranks, [*_Q, "marker"], "left_anti")


def _claims(answers: DataFrame) -> DataFrame:
    """One row for each sentence of an answer: pos, claim."""
    return answers.select(*_Q, F.posexplode(claims(F.col("answer"))).alias("pos", "claim"))


def words_of(c: F.Column) -> F.Column:
    """Distinct lower-case words; markers are no words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace(c, r"\[[0-9, ]+\]", " ")), F.lit(r"([\p{L}\p{N}]+)"), 1))


def quotes(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """For each marker of an answer that is a passage's rank: doc_id and the passage's sentence that supports the
    marked claims best (most words in common, then the first). ``passages``: run_id, query_id, rank, doc_id, text.
    A passage of null or empty text has a null quote; a passage listed twice counts once."""
    marked = _claims(answers).select(*_Q, F.explode(markers(F.col("claim"))).alias("rank"), words_of(F.col("claim")).alias("w"))
    marked = marked.groupBy(*_Q, "rank").agg(F.array_distinct(F.flatten(F.collect_list("w"))).alias("w"))
    once = passages.groupBy(*_Q, "rank").agg(F.min(F.struct("doc_id", "text")).alias("p")).select(*_Q, "rank", "p.*")
    spans = marked.join(once, [*_Q, "rank"]).select(*_Q, "rank", "doc_id", "w", F.posexplode_outer(split_sentences(F.col("text"))).alias("pos", "span"))
    best = F.min(F.struct((-F.size(F.array_intersect("w", words_of(F.col("span"))))).alias("o"), "pos", "span"))
    return spans.groupBy(*_Q, "rank", "doc_id").agg(best.alias("b")).select(*_Q, F.col("rank").alias("marker"), "doc_id", F.col("b.span").alias("quote"))


def references(citations: DataFrame, papers: DataFrame) -> DataFrame:
    """references: the lines "[n] authors (year). title. url" of an answer's citations in order of their markers; a
    document that is not known has its id for a title. ``citations``: marker, doc_id."""
    line = F.concat(author_list(F.col("authors")), F.lit(" ("), F.coalesce(F.nullif("year", F.lit(0)).cast("string"), F.lit("n.d.")), F.lit("). "), F.coalesce("title", "doc_id"), F.coalesce(F.concat(F.lit(". "), landing_url(F.col("url"), F.col("doi"))), F.lit("")))
    known = papers.where("doc_id is not null").groupBy("doc_id").agg(F.min(line).alias("line"))
    rows = citations.join(known, "doc_id", "left").select(*_Q, "marker", F.concat(F.lit("["), F.col("marker").cast("string"), F.lit("] "), F.coalesce("line", "doc_id")).alias("line"))
    ordered = F.transform(F.array_sort(F.collect_set(F.struct("marker", "line"))), lambda x: x["line"])
    return rows.groupBy(*_Q).agg(F.array_join(ordered, "\n").alias("references"))


def audit(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """citation_coverage (share of sentences with a marker), unique_sources, fabricated, passages_supplied."""
    parts = answers.select(*_Q, F.explode(claims(F.col("answer"))).alias("s"))
    cover = parts.groupBy(*_Q).agg(F.round(F.avg(F.when(F.col("s").rlike(r"\[[0-9]"), 1.0).otherwise(0.0)), 6).alias("citation_coverage"))
    good, bad = resolve_citations(answers, hits)
    sources = good.groupBy(*_Q).agg(F.countDistinct("doc_id").alias("unique_sources"))
    lost = bad.groupBy(*_Q).agg(F.count("*").alias("fabricated"))
    given = hits.groupBy(*_Q).agg(F.countDistinct("rank").alias("passages_supplied"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = answers.select(*_Q)
    for part in (cover, sources, lost, given):
        rows = rows.join(part, _Q, "left")
    return rows.select(*_Q, "citation_coverage", zero("unique_sources"), zero("fabricated"), zero("passages_supplied"))


def fabricated_rate(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """markers, fabricated and their rate over all answers; null without markers."""
    good, bad = resolve_citations(answers, hits)
    n = good.select(F.lit(0).alias("f")).union(bad.select(F.lit(1).alias("f")))
    return n.agg(F.count("*").alias("markers"), F.coalesce(F.sum("f"), F.lit(0)).alias("fabricated"), F.round(F.avg("f"), 6).alias("rate"))


def citation_accuracy(citations: DataFrame, golden: DataFrame) -> DataFrame:
    gold = golden.select(F.col("qid").alias("query_id"), "gold_doc_ids")
    right = F.when(F.coalesce(F.array_contains("gold_doc_ids", F.col("doc_id")), F.lit(False)), 1.0).otherwise(0.0)
    return citations.join(gold, "query_id").groupBy(*_Q).agg(F.round(F.avg(right), 6).alias("citation_accuracy"))


def answer_correctness(answers: DataFrame, golden: DataFrame, answer: str = "answer") -> DataFrame:
    """qid, correctness (share of answer points found, without regard to case) and the missing ones."""
    points = golden.select("qid", F.explode("answer_points").alias("point")).where("point is not null").distinct()
    rows = answers.select("qid", answer).join(points, "qid").withColumn("has", F.coalesce(F.contains(F.lower(answer), F.lower("point")), F.lit(False)))
    return rows.groupBy("qid").agg(F.round(F.avg(F.col("has").cast("double")), 6).alias("correctness"), F.array_sort(F.collect_list(F.when(~F.col("has"), F.col("point")))).alias("missing"))


def supported_claims(answers: DataFrame, passages: DataFrame, least: float = 0.6) -> DataFrame:
    """qid, pos, claim, share, supported: a claim is supported if one passage of the question holds a share of ``least``
    of its words; joined on words, not sentence by passage. Sentences without words are no claims."""
    said = answers.select("qid", F.posexplode(claims(F.col("answer"))).alias("pos", "claim")).withColumn("w", words_of(F.col("claim"))).where(F.size("w") > 0)
    left = said.select("qid", "pos", F.size("w").alias("n"), F.explode("w").alias("word"))
    right = passages.select("qid", "rank", F.explode(words_of(F.col("text"))).alias("word")).distinct()
    share = left.join(right, ["qid", "word"]).groupBy("qid", "pos", "rank").agg((F.count("*") / F.max("n")).alias("share")).groupBy("qid", "pos").agg(F.max("share").alias("share"))
    rows = said.select("qid", "pos", "claim").join(share, ["qid", "pos"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    return rows.withColumn("supported", F.col("share") >= least)


def faithfulness(answers: DataFrame, passages: DataFrame, least: float = 0.6) -> DataFrame:
    """qid, faithfulness (share of supported claims), hallucination (the rest), n_supported, n_sentences and the
    unsupported claims in order."""
    rows = supported_claims(answers, passages, least)
    lost = F.transform(F.array_sort(F.collect_list(F.when(~F.col("supported"), F.struct("pos", "claim")))), lambda x: x["claim"])
    share = F.avg(F.col("supported").cast("double"))
    return rows.groupBy("qid").agg(F.round(share, 6).alias("faithfulness"), F.round(1 - share, 6).alias("hallucination"), F.count_if("supported").alias("n_supported"), F.count("*").alias("n_sentences"), lost.alias("unsupported"))


def context_scores(doc_hits: DataFrame, golden: DataFrame) -> DataFrame:
    """context_precision (share of retrieved documents that are gold) and context_recall (share of gold documents that
    were retrieved) of each asked question with gold documents. ``doc_hits``: a document once for each question."""
    from folio.operators.evaluation import gold_edges

    edges = gold_edges(golden).withColumnRenamed("qid", "query_id")
    n_gold = edges.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    rows = doc_hits.select(*_Q, "doc_id").distinct().join(n_gold, "query_id").join(edges.withColumn("gold", F.lit(1)), ["query_id", "doc_id"], "left")
    found = F.count("gold")
    return rows.groupBy(*_Q).agg(F.round(found / F.count("*"), 6).alias("context_precision"), F.round(found / F.max("n_gold"), 6).alias("context_recall"))


def prompts(questions: DataFrame, passages: DataFrame, budget: int = 2200) -> DataFrame:
    """qid, prompt: the question and its numbered passages while they fit the budget of characters."""
    run = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    fit = passages.withColumn("sum", F.sum(F.length("text")).over(run)).where(F.col("sum") <= budget)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["text"])), "\n")
    context = fit.groupBy("qid").agg(lines.alias("context"))
    return questions.join(context, "qid", "left").select("qid", F.concat(F.lit("QUESTION: "), "question", F.lit("\nCONTEXT:\n"), F.coalesce("context", F.lit(""))).alias("prompt"))


def system_prompt(refusal: str = REFUSAL, persona: str = "a careful assistant") -> str:
    """The constant instruction: cite by number, answer from the passages only, else the refusal token."""
    return f"You are {persona}. Answer from the numbered passages only and mark each claim with the number of its passage, like [1]. If the passages do not answer the question, reply with {refusal} and nothing else."


def refusal_block(decided: DataFrame, golden: DataFrame) -> DataFrame:
    """n, refused, refusal_accuracy (right decisions), incorrectly_answered, over_refused and the qids of the latter."""
    rows = decided.join(golden.select(F.col("qid").alias("query_id"), F.coalesce(F.col("expected") == "answer", F.lit(False)).alias("answerable")), "query_id")
    a, r = F.col("answerable"), F.col("refused")
    return rows.agg(
        F.count("*").alias("n"), F.count_if(r).alias("refused"), F.round(F.avg((a != r).cast("double")), 6).alias("refusal_accuracy"), F.count_if(~a & ~r).alias("incorrectly_answered"), F.count_if(a & r).alias("over_refused"),
        F.array_sort(F.collect_set(F.when(a & r, F.col("query_id")))).alias("over_refused_qids"),
    )


def word_cosine(a: F.Column, b: F.Column) -> F.Column:
    """Cosine of two arrays of distinct words; null if one is empty. Relevancy of an answer without an encoder."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.sqrt(F.size(a)) * F.sqrt(F.size(b)))
