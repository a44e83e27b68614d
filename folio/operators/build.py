"""Corpus construction: batches, overlays, one record for each work, stubs, order, snapshot and summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.text import author_list, sections_of, stable_hash, strip, tag_union
from folio.operators.corpus import MIN_CHARS, doi_key, keep_action, upper_median

STUB = "[stub]"


def union_batches(batches: list[tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """UNION ALL in the given order, with ``src_order`` (from 0). A batch's constants (such as stratum and topic) replace
    its columns; columns a batch lacks are null."""
    out = None
    for i, (rows, constants) in enumerate(batches):
        for name, value in constants.items():
            rows = rows.withColumn(name, F.lit(value))
        rows = rows.withColumn("src_order", F.lit(i))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("no batches")
    return out


def overlay(docs: DataFrame, groups: DataFrame, columns: tuple[str, ...] = ("stratum", "topic", "note")) -> DataFrame:
    """Metadata of ``groups`` (doc_id, ord, tags, ``columns``) over ``docs``: a group's value wins where it has one, of
    several groups for one id the one of the greatest ord; tags of all groups are added to the document's."""
    latest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("ord"))).alias(f"__{c}") for c in columns]
    tags = F.array_distinct(F.flatten(F.collect_set(F.coalesce("tags", F.array().cast("array<string>"))))).alias("__tags")
    meta = groups.where("doc_id is not null").groupBy("doc_id").agg(*latest, tags)
    rows = docs.join(meta, "doc_id", "left")
    for c in columns:
        rows = rows.withColumn(c, F.coalesce(f"__{c}", c))
    rows = rows.withColumn("tags", tag_union(F.col("tags"), F.col("__tags")))
    return rows.drop("__tags", *[f"__{c}" for c in columns])


def inline_records(rows: DataFrame) -> DataFrame:
    """Records supplied by an author (title, text, and what else is known): those with blank text are skipped; source,
    stratum, topic and title have defaults, a missing id is a hash of title and text."""
    text = strip(F.col("text"))
    good = rows.where(F.coalesce(text != "", F.lit(False))).withColumn("text", text)
    default = {"title": "Untitled", "source": "author_supplied", "stratum": "methods", "topic": "own work"}
    for c, value in default.items():
        good = good.withColumn(c, F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(value)) if c in good.columns else F.lit(value))
    made = F.concat(F.lit("manual:"), stable_hash(F.col("title"), F.col("text"), length=12))
    return good.withColumn("doc_id", F.coalesce(F.nullif(F.col("doc_id"), F.lit("")), made) if "doc_id" in good.columns else made)


def stub_text() -> F.Column:
    """The labelled text of a record without one, from its metadata; parts that are missing are left out."""
    part = lambda label, c: F.when(c != "", F.concat(F.lit(label), c))
    year = F.when(F.col("year") != 0, F.col("year").cast("string"))
    return F.concat_ws(". ", F.lit(STUB + " Metadata only"), part("Title: ", F.col("title")), part("Authors: ", F.nullif(author_list(F.col("authors")), F.lit("Unknown"))), part("Venue: ", F.col("venue")), part("Year: ", year), part("DOI: ", F.col("doi")))


def one_record_each(docs: DataFrame) -> DataFrame:
    """The whole record with most text for each DOI, else title, else doc_id (then the earlier batch by ``src_order``, if
    there is one, then the lesser id). By an aggregate that combines before its shuffle."""
    title = F.lower(F.regexp_replace(strip(F.col("title")), r"\s+", " "))
    key = F.coalesce(F.concat(F.lit("doi:"), doi_key()), F.concat(F.lit("title:"), F.when(title != "", title)), F.concat(F.lit("id:"), F.col("doc_id")))
    early = F.col("src_order") if "src_order" in docs.columns else F.lit(0)
    order = F.struct((-F.coalesce(F.length("text"), F.lit(0))).alias("m"), early.alias("o"), F.col("doc_id").alias("i"))
    return docs.withColumn("__k", key).groupBy("__k").agg(F.min_by(F.struct(*docs.columns), order).alias("r")).select("r.*")


def build_corpus(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Deduplicated records with ``action`` keep or stub; stubs have their made-up text and a tag."""
    kept = keep_action(one_record_each(docs), min_chars).where("action <> 'drop'")
    stub = F.col("action") == "stub"
    return kept.withColumn("tags", F.when(stub, tag_union(F.col("tags"), F.array(F.lit("stub")))).otherwise(F.col("tags"))).withColumn("text", F.when(stub, stub_text()).otherwise(F.col("text")))


def account(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row: n_in, deduped, kept, stubs, dropped, and whether they add up."""
    actions = keep_action(one_record_each(docs).select("doc_id", "text", "tags", "source"), min_chars)
    counts = actions.agg(F.count("*").alias("n"), *[F.count_if(F.col("action") == a).alias(c) for a, c in (("keep", "kept"), ("stub", "stubs"), ("drop", "dropped"))])
    rows = docs.agg(F.count("*").alias("n_in")).crossJoin(counts)  # one row each
    return rows.select("n_in", (F.col("n_in") - F.col("n")).alias("deduped"), "kept", "stubs", "dropped", (F.col("n") == F.col("kept") + F.col("stubs") + F.col("dropped")).alias("adds_up"))


def in_corpus_order(docs: DataFrame) -> DataFrame:
    return docs.orderBy("stratum", "topic", "doc_id")


def snapshot_hash(docs: DataFrame, length: int = 16) -> DataFrame:
    """snapshot_hash: 16 signs that tell which records a corpus holds. The order of a corpus follows from its records, so
    the hash is that of the sum of the records' hashes, which needs neither a sort nor all ids in one place; repeated
    records count."""
    one = F.conv(F.substring(F.sha2(F.concat_ws("\u001f", *[F.coalesce(c, F.lit("")) for c in ("stratum", "topic", "doc_id")]), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return docs.agg(F.substring(F.sha2(F.coalesce(F.sum(one), F.lit(0)).cast("string"), 256), 1, length).alias("snapshot_hash"))


def reparse_sections(docs: DataFrame) -> DataFrame:
    """doc_id, old and new numbers of sections, and whether they differ."""
    old = F.coalesce(F.size("sections"), F.lit(0))
    new = F.coalesce(F.size(sections_of(F.col("text"))), F.lit(0))
    return docs.select("doc_id", F.when(old < 0, 0).otherwise(old).alias("n_old"), F.when(new < 0, 0).otherwise(new).alias("n_new")).withColumn("changed", F.col("n_old") != F.col("n_new"))


def summarise(docs: DataFrame) -> DataFrame:
    """One row: the eight plain statistics; counts by stratum, source and topic are ``counts``."""
    p = docs.withColumn("__n", F.coalesce(F.length("text"), F.lit(0)))
    year = F.when(F.col("year") != 0, F.col("year"))
    stats = p.agg(
        F.count("*").alias("n_documents"), F.min(year).alias("year_min"), F.max(year).alias("year_max"), F.coalesce(F.sum("__n"), F.lit(0)).alias("chars"), F.bround(F.coalesce(F.sum("__n"), F.lit(0)) / 4).cast("long").alias("approx_tokens"),
        F.count_if(F.size("sections") > 1).alias("n_with_sections"), F.count_if(F.col("doi") != "").alias("n_with_doi"), F.count_if(F.size("authors") > 0).alias("n_with_authors"),
    )
    return stats.crossJoin(upper_median(p, "__n"))  # one row each


def counts(docs: DataFrame, columns: tuple[str, ...] = ("stratum", "source", "topic")) -> DataFrame:
    """Counts of each column's values in one pass; ``level`` tells the column."""
    return docs.groupingSets([[c] for c in columns], *columns).agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"))


def manifest(docs: DataFrame, dropped: int, min_chars: int, built_at_utc: str) -> DataFrame:
    """One row about a build: when, the snapshot, what was dropped, and the statistics."""
    return snapshot_hash(docs).crossJoin(summarise(docs)).withColumn("built_at_utc", F.lit(built_at_utc)).withColumn("dropped_short_documents", F.lit(dropped)).withColumn("min_chars", F.lit(min_chars))  # one row each

