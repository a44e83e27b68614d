"""Chunking, golden-set validation and extractive answers, and the keys of corpus construction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import sections_of, split_sentences, strip

MIN_CHARS = 250
CHUNK_SIZE, CHUNK_OVERLAP, MIN_CHUNK = 900, 150, 120
TERM_CHARS = 20_000_000  # of the terms that are sent to executors at once
# The terms a golden set may use.
STRATA = ("clinical", "methods", "rag")
CATEGORIES = ("methodological", "factual", "numeric", "comparative", "definitional", "multi_hop", "bibliographic", "own_work")
CHALLENGES = ("semantic", "lexical", "both", "none")
DIFFICULTIES = ("easy", "medium", "hard")


def doi_key(c: str | F.Column = "doi") -> F.Column:
    bare = F.lower(F.regexp_replace(strip(F.col(c) if isinstance(c, str) else c), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", ""))
    return F.when(bare != "", bare)


def dedupe_documents(docs: DataFrame) -> DataFrame:
    """One record for each DOI, else title, else doc_id: the one with more text (ties: lesser doc_id).
    An aggregate that combines before the shuffle, so a key with a third of all rows is no hot task."""
    title = F.lower(F.regexp_replace(strip(F.col("title")), r"\s+", " "))
    key = F.coalesce(F.concat(F.lit("doi:"), doi_key()), F.concat(F.lit("title:"), F.when(title != "", title)), F.concat(F.lit("id:"), F.col("doc_id")))
    length = F.coalesce(F.length("text"), F.lit(0))
    return docs.select(key.alias("key"), "doc_id", length.alias("n")).groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("m"), "doc_id")).alias("r"), F.count("*").alias("records")).select("key", F.col("r.doc_id").alias("doc_id"), (-F.col("r.m")).alias("n_chars"), "records")


def keep_action(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """keep, stub or drop, by stripped length, tags and source; nulls count as empty."""
    long = F.length(F.coalesce(strip(F.col("text")), F.lit(""))) >= min_chars
    known = F.coalesce(F.array_contains("tags", "pinned"), F.lit(False)) | F.coalesce(F.col("source").isin("crossref", "author_supplied"), F.lit(False))
    return docs.withColumn("action", F.when(long, "keep").when(known, "stub").otherwise("drop"))


def upper_median(values: DataFrame, value: str) -> DataFrame:
    """The element at n // 2 of the sorted values, from the counts of distinct ones."""
    counts = values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("v"))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    return upto.where(F.expr("upto > total div 2")).agg(F.min("v").alias("median"))


def _pieces(sentence: str, size: int) -> Iterator[str]:
    """A sentence in parts of at most ``size`` characters, cut at the last space before the limit; a run without
    spaces is cut at the limit."""
    while len(sentence) > size:
        at = sentence.rfind(" ", 1, size + 1)
        at = at if at > 0 else size
        yield sentence[:at].rstrip()
        sentence = sentence[at:].lstrip()
    if sentence:
        yield sentence


def pack_sentences(sentences: list[str], size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, least: int = MIN_CHUNK) -> list[str]:
    """Sentences packed greedily into chunks of at most ``size``, each repeating trailing sentences of the chunk before it
    of up to ``overlap`` characters while that leaves room; a last one of less than ``least`` is merged, so that only it may
    reach ``size`` + ``least``. A sentence longer than ``size`` is cut first. Linear in the text."""
    done: list[str] = []
    cur: list[str] = []
    width = fresh = 0  # characters of cur, and its sentences that are new
    for s in (p for x in sentences if x for p in _pieces(x, size)):
        if fresh and width + 1 + len(s) > size:
            done.append(" ".join(cur))
            keep, kept = 0, 0
            while keep < len(cur) and kept + len(cur[-1 - keep]) + (kept > 0) <= overlap:
                kept += len(cur[-1 - keep]) + (kept > 0)
                keep += 1
            cur = cur[len(cur) - keep :] if keep else []
            width, fresh = kept, 0
            while cur and width + 1 + len(s) > size:
                width -= len(cur.pop(0)) + 1
            width = max(width, 0) if cur else 0
        width += len(s) + (1 if cur else 0)
        cur.append(s)
        fresh += 1
    if fresh:
        last = " ".join(cur)
        if done and len(" ".join(cur[len(cur) - fresh :])) < least:
            done[-1] += " " + " ".join(cur[len(cur) - fresh :])
        else:
            done.append(last)
    return done


def chunk_documents(papers: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, least: int = MIN_CHUNK) -> DataFrame:
    """Chunks within sections: doc_id, pos, section, index, header, text. Papers without sections are parsed (headings leave
    the text); null and blank bodies give none; the header is kept out of the text. Sentences are split in the JVM and
    packed in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([pack_sentences(x, size, overlap, least) for x in batch.column(4).to_pylist()], pa.list_(pa.string()))], ["doc_id", "title", "pos", "section", "chunks"])

    given = F.transform("sections", lambda s: F.struct(s["pos"].alias("pos"), s["heading"].alias("heading"), s["body"].alias("body")))
    parts = F.when(F.col("sections").isNull() | (F.size("sections") == 0), sections_of(F.col("text"))).otherwise(given)
    rows = papers.select("doc_id", "title", F.explode(parts).alias("s")).where("s.body is not null")
    rows = rows.select("doc_id", "title", F.col("s.pos").alias("pos"), F.col("s.heading").alias("section"), split_sentences(F.col("s.body")).alias("sentences"))
    cut = rows.mapInArrow(run, "doc_id string, title string, pos int, section string, chunks array<string>")
    header = F.concat_ws(" > ", "title", "section")
    return cut.select("doc_id", "pos", "section", header.alias("header"), F.posexplode("chunks").alias("index", "text")).select("doc_id", "pos", "section", "index", "header", "text")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """One row: n_chunks, n_documents, n_sections, mean, median (upper), min and max characters."""
    rows = chunks.withColumn("__n", F.length("text"))
    stats = rows.agg(F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_documents"), F.countDistinct(F.struct("doc_id", "section")).alias("n_sections"), F.round(F.avg("__n"), 6).alias("mean_chars"), F.min("__n").alias("min_chars"), F.max("__n").alias("max_chars"))
    return stats.crossJoin(upper_median(rows, "__n").withColumnRenamed("median", "median_chars"))  # one row each


def golden_errors(golden: DataFrame, papers: DataFrame) -> DataFrame:
    """(qid, rule): the violations of the golden set that need no text search."""
    g = golden.withColumn("q", F.lower(F.coalesce(strip(F.col("question")), F.lit("")))).withColumn("id", F.coalesce("qid", F.lit("<no qid>")))
    answer = F.coalesce(F.col("expected") == "answer", F.lit(False))
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    out = lambda c, values: ~F.coalesce(F.col(c).isin(*values), F.lit(False))
    nth = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("id", "question"))
    rules = {
        "duplicate_qid": nth("id") > 1, "empty_question": F.col("q") == "", "duplicate_question": (nth("q") > 1) & (F.col("q") != ""), "stratum": out("stratum", STRATA), "category": out("category", CATEGORIES),
        "no_gold": answer & none("gold_doc_ids"), "no_answer_points": answer & none("answer_points"), "challenge": answer & out("retrieval_challenge", CHALLENGES), "difficulty": answer & out("difficulty", DIFFICULTIES),
        "no_proof": ~answer & none("absent_terms") & none("must_not_cooccur"),
    }
    flags = g.select(F.col("id").alias("qid"), *[c.alias(k) for k, c in rules.items()])
    found = flags.select("qid", F.explode(F.array(*[F.when(F.col(k), F.lit(k)) for k in rules])).alias("rule")).where("rule is not null")
    gold = g.where(answer).select(F.col("id").alias("qid"), F.explode("gold_doc_ids").alias("doc_id"))
    missing = gold.join(papers.select("doc_id").distinct(), "doc_id", "left_anti").select("qid", F.lit("unknown_gold").alias("rule"))
    return found.union(missing)


def term_blocks(terms: list[str]) -> Iterator[list[str]]:
    """The terms in blocks of at most ``TERM_CHARS`` characters (a longer term is a block of its own)."""
    block, size = [], 0
    for t in terms:
        if block and size + len(t) > TERM_CHARS:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t)
    if block:
        yield block


def occurring(terms: list[str], docs: DataFrame) -> DataFrame:
    """(doc_id, t, terms): documents with those of the lower-cased ``terms`` that their lower-cased title and text
    contain. One pass over the texts for each block of terms, by an automaton over all of them where one is installed."""
    text = docs.select("doc_id", F.lower(F.concat_ws(" ", "title", "text")).alias("t"))
    found = None
    for block in term_blocks(sorted(set(terms))):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            try:
                import ahocorasick

                automaton = ahocorasick.Automaton()
                for t in block:
                    if t:
                        automaton.add_word(t, t)
                automaton.make_automaton()
                match = (lambda s: {t for _, t in automaton.iter(s)}) if len(automaton) else (lambda s: set())
            except ImportError:
                match = lambda s: {t for t in block if t and t in s}
            always = {t for t in block if not t}
            for batch in batches:
                rows = [sorted(match(s) | always) for s in batch.column(1).to_pylist()]
                keep = pa.array([bool(r) for r in rows])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.string()))], ["doc_id", "terms"]).filter(keep)

        part = text.mapInArrow(run, "doc_id string, terms array<string>")
        found = part if found is None else found.union(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], "doc_id string, terms array<string>")


def contained(terms: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, term) of ``terms`` with a document whose lower-cased title and text contain the term; an empty term is in
    every document. Terms are those of a golden set, sent in blocks of bounded size."""
    wanted = terms.select("qid", "term", F.lower("term").alias("low")).where("term is not null").distinct()
    found = occurring([r.low for r in wanted.select("low").distinct().collect()], docs)
    return wanted.join(found.select(F.explode("terms").alias("low")).distinct(), "low").select("qid", "term")


def cooccurrences(groups: DataFrame, docs: DataFrame) -> DataFrame:
    """``groups``: qid, terms. For each group the number of documents that contain all of its terms, and the least
    doc_id; groups that no document holds have no row. A group with a null term is held by none."""
    wanted = groups.select("qid", "terms").where(F.coalesce(F.size("terms") > 0, F.lit(False)) & ~F.exists("terms", lambda x: x.isNull())).distinct()
    low = wanted.withColumn("low", F.array_distinct(F.transform("terms", lambda x: F.lower(x))))
    docs = docs.select("doc_id", "title", "text").distinct()
    held = occurring([r.t for r in low.select(F.explode("low").alias("t")).distinct().collect()], docs)
    flat = held.select("doc_id", F.explode("terms").alias("t"))
    hits = flat.join(low.select("qid", "terms", F.size("low").alias("need"), F.explode("low").alias("t")), "t").groupBy("qid", "terms", "need", "doc_id").agg(F.countDistinct("t").alias("n")).where("n = need")
    return hits.groupBy("qid", "terms").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))


def composition(golden: DataFrame) -> DataFrame:
    """(field, value, n) of five columns; nulls are counted for three, skipped for two."""
    fields = ["category", "stratum", "expected", "difficulty", "retrieval_challenge"]
    rows = golden.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("c")).select("c.*")
    return rows.where("value is not null or field not in ('difficulty', 'retrieval_challenge')").groupBy("field", "value").agg(F.count("*").alias("n"))


def extractive_answers(questions: DataFrame, passages: DataFrame, top: int = 3) -> DataFrame:
    """``questions``: qid, terms; ``passages``: qid, rank, text. The ``top`` sentences that share most
    terms, each with its passage's marker; without any, the refusal token."""
    sentences = passages.select("qid", "rank", F.posexplode(split_sentences(F.col("text"))).alias("pos", "sentence"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("sentence"), F.lit(r"([\p{L}\p{N}]+)"), 1))
    scored = sentences.join(questions, "qid").withColumn("overlap", F.size(F.array_intersect(words, "terms"))).where("overlap > 0")
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("overlap"), "rank", "pos"))).where(F.col("n") <= top)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat("sentence", F.lit(" ["), F.col("rank").cast("string"), F.lit("]")).alias("s")))), lambda x: x["s"])
    answers = best.groupBy("qid").agg(F.array_join(lines, " ").alias("answer"))
    return questions.select("qid").distinct().join(answers, "qid", "left").select("qid", F.coalesce("answer", F.lit("INSUFFICIENT_CONTEXT")).alias("answer"))
