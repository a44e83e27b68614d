"""Queries of corpus construction over whole tables, and SQL that says what they compute."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.operators import build as K
from folio.plans.queries import _NAMES, query, table

FILLED = "nullif({}, '')"
KEYED = r"""k AS (SELECT *, coalesce(length(text), 0) AS n, nullif(lower(regexp_replace(regexp_replace(doi, '^\s+|\s+$', '', 'g'), '^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)', '', 'i')), '') AS d, nullif(lower(regexp_replace(regexp_replace(title, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')), '') AS t FROM papers),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce('doi:' || d, 'title:' || t, 'id:' || doc_id) ORDER BY n DESC, doc_id) AS i FROM k) WHERE i = 1),
act AS (SELECT *, CASE WHEN length(coalesce(regexp_replace(text, '^\s+|\s+$', '', 'g'), '')) >= 250 THEN 'keep' WHEN coalesce(list_contains(tags, 'pinned'), false) OR coalesce(source IN ('crossref', 'author_supplied'), false) THEN 'stub' ELSE 'drop' END AS action FROM one)"""
AUTHORS = "CASE WHEN coalesce(len(list_filter(authors, lambda a: a IS NOT NULL)), 0) = 0 THEN NULL ELSE array_to_string(list_filter(authors, lambda a: a IS NOT NULL)[1:3], ', ') || CASE WHEN len(list_filter(authors, lambda a: a IS NOT NULL)) > 3 THEN ' et al.' ELSE '' END END"
STUB = f"concat_ws('. ', '[stub] Metadata only', 'Title: ' || nullif(title, ''), 'Authors: ' || {AUTHORS}, 'Venue: ' || nullif(venue, ''), 'Year: ' || CAST(nullif(year, 0) AS VARCHAR), 'DOI: ' || nullif(doi, ''))"


def _papers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "papers")


def _batches(s: SparkSession, d: str) -> DataFrame:
    """Fetched, pinned and hand-made papers as three batches, of which the last two have constants."""
    p = _papers(s, d).select("doc_id", "stratum", "topic", "source", "tags")
    pinned = F.coalesce(F.array_contains("tags", "pinned"), F.lit(False))
    manual = F.coalesce(F.col("doc_id").startswith("manual:"), F.lit(False))
    return K.union_batches([(p.where(~pinned & ~manual), {}), (p.where(pinned & ~manual).drop("tags"), {"topic": "pinned"}), (p.where(manual), {"stratum": "methods", "topic": "inbox"})])


@query("""SELECT src_order, stratum, topic, count(*) AS n, count(tags) AS n_tagged FROM (SELECT CASE WHEN m THEN 2 WHEN p THEN 1 ELSE 0 END AS src_order, CASE WHEN m THEN 'methods' ELSE stratum END AS stratum, CASE WHEN m THEN 'inbox' WHEN p THEN 'pinned' ELSE topic END AS topic, CASE WHEN p AND NOT m THEN NULL ELSE tags END AS tags
FROM (SELECT *, coalesce(list_contains(tags, 'pinned'), false) AS p, coalesce(starts_with(doc_id, 'manual:'), false) AS m FROM papers)) GROUP BY 1, 2, 3""")
def union_batches(s: SparkSession, d: str) -> DataFrame:
    return _batches(s, d).groupBy("src_order", "stratum", "topic").agg(F.count("*").alias("n"), F.count("tags").alias("n_tagged"))


@query("""WITH g AS (SELECT unnest(gold_doc_ids) AS doc_id, qid AS ord, stratum, CASE WHEN difficulty = 'hard' THEN category END AS topic, note, [category, difficulty] AS tags FROM golden),
m AS (SELECT doc_id, arg_max(stratum, ord) FILTER (stratum IS NOT NULL) AS stratum, arg_max(topic, ord) FILTER (topic IS NOT NULL) AS topic, list(tags) AS tags FROM g WHERE doc_id IS NOT NULL GROUP BY 1)
SELECT DISTINCT p.doc_id, regexp_replace(p.doc_id, '^[^:]*:', '') AS bare_id, coalesce(m.stratum, p.stratum) AS stratum, coalesce(m.topic, p.topic) AS topic, list_sort(list_distinct(list_filter(list_concat(coalesce(p.tags, []), coalesce(flatten(m.tags), [])), lambda x: x IS NOT NULL))) AS tags FROM papers p LEFT JOIN m USING (doc_id)""")
def metadata_overlay(s: SparkSession, d: str) -> DataFrame:
    golden = table(s, d, "golden")
    groups = golden.select(F.explode("gold_doc_ids").alias("doc_id"), F.col("qid").alias("ord"), "stratum", F.when(F.col("difficulty") == "hard", F.col("category")).alias("topic"), F.array("category", "difficulty").alias("tags"))
    docs = K.overlay(_papers(s, d).select("doc_id", "stratum", "topic", "tags"), groups, ("stratum", "topic"))
    return docs.select("doc_id", X.bare_id(F.col("doc_id")).alias("bare_id"), "stratum", "topic", "tags").distinct()


@query(f"WITH {KEYED} SELECT (SELECT count(*) FROM papers) AS n_in, (SELECT count(*) FROM papers) - count(*) AS deduped, count(*) FILTER (action = 'keep') AS kept, count(*) FILTER (action = 'stub') AS stubs, count(*) FILTER (action = 'drop') AS dropped, true AS adds_up FROM act")
def corpus_account(s: SparkSession, d: str) -> DataFrame:
    return K.account(_papers(s, d))


@query(f"WITH {KEYED} SELECT doc_id, action, CASE WHEN action = 'stub' THEN list_sort(list_distinct(list_concat(coalesce(tags, []), ['stub']))) ELSE tags END AS tags, md5(CASE WHEN action = 'stub' THEN {STUB} ELSE text END) AS h FROM act WHERE action <> 'drop'")
def corpus_build(s: SparkSession, d: str) -> DataFrame:
    return K.build_corpus(_papers(s, d)).select("doc_id", "action", "tags", F.md5("text").alias("h"))


@query(f"WITH {KEYED} SELECT stratum, topic, doc_id, CAST(row_number() OVER (ORDER BY stratum NULLS FIRST, topic NULLS FIRST, doc_id) AS INTEGER) AS place FROM (SELECT * FROM act WHERE action = 'keep' ORDER BY stratum NULLS FIRST, topic NULLS FIRST, doc_id LIMIT 50)")
def corpus_head(s: SparkSession, d: str) -> DataFrame:
    """The first 50 records in corpus order (a top-k report)."""
    head = K.in_corpus_order(K.build_corpus(_papers(s, d)).where("action = 'keep'").select("stratum", "topic", "doc_id")).limit(50)
    return head.select("stratum", "topic", "doc_id", F.row_number().over(Window.orderBy("stratum", "topic", "doc_id")).alias("place"))


@query(f"SELECT DISTINCT doc_id, md5({STUB}) AS h FROM papers")
def stub_texts(s: SparkSession, d: str) -> DataFrame:
    return _papers(s, d).select("doc_id", F.md5(K.stub_text()).alias("h")).distinct()


@query("SELECT substr(sha256(CAST(coalesce(sum(CAST(concat('0x', substr(sha256(concat_ws(chr(31), coalesce(stratum, ''), coalesce(topic, ''), coalesce(doc_id, ''))), 1, 12)) AS BIGINT)), 0) AS VARCHAR)), 1, 16) AS snapshot_hash FROM papers")
def snapshot_hash(s: SparkSession, d: str) -> DataFrame:
    return K.snapshot_hash(_papers(s, d))


@query(r"""WITH b AS (SELECT regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, coalesce(nullif(title, ''), 'Untitled') AS title, coalesce(nullif(source, ''), 'author_supplied') AS source, coalesce(nullif(stratum, ''), 'methods') AS stratum, coalesce(nullif(topic, ''), 'own work') AS topic FROM papers)
SELECT DISTINCT 'manual:' || substr(sha256(concat_ws(chr(31), title, text)), 1, 12) AS doc_id, title, source, stratum, topic, md5(text) AS h FROM b WHERE text <> ''""")
def inline_records(s: SparkSession, d: str) -> DataFrame:
    """The papers taken as records without ids."""
    return K.inline_records(_papers(s, d).drop("doc_id")).select("doc_id", "title", "source", "stratum", "topic", F.md5("text").alias("h")).distinct()


@query(rf"""WITH m AS (SELECT doc_id, sections, text, regexp_replace(text, '(?m)^#{{1,6}}[ \t]+(.+)$', chr(1) || '\1' || chr(2), 'g') AS md, regexp_replace(text, '(^|[.!?]\s*|\n)({_NAMES})(?::\s*|([A-Z]))', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g') AS plain FROM papers),
p AS (SELECT DISTINCT doc_id, CAST(coalesce(len(sections), 0) AS INTEGER) AS n_old, CAST(CASE WHEN text IS NULL THEN 0 ELSE greatest(1, len(list_filter(string_split(CASE WHEN contains(md, chr(1)) THEN md ELSE plain END, chr(1)), lambda x: contains(x, chr(2))))) END AS INTEGER) AS n_new FROM m)
SELECT *, n_old <> n_new AS changed FROM p""")
def reparse_sections(s: SparkSession, d: str) -> DataFrame:
    return K.reparse_sections(_papers(s, d)).distinct()


@query("""SELECT count(*) AS n_documents, min(CASE WHEN year <> 0 THEN year END) AS year_min, max(CASE WHEN year <> 0 THEN year END) AS year_max, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS chars, CAST(round_even(sum(coalesce(length(text), 0)) / 4, 0) AS BIGINT) AS approx_tokens, count(*) FILTER (len(sections) > 1) AS n_with_sections, count(*) FILTER (doi <> '') AS n_with_doi, count(*) FILTER (len(authors) > 0) AS n_with_authors,
(SELECT n[CAST(len(n) // 2 + 1 AS INTEGER)] FROM (SELECT list(CAST(coalesce(length(text), 0) AS INTEGER) ORDER BY length(text) NULLS FIRST) AS n FROM papers)) AS median FROM papers""")
def corpus_statistics(s: SparkSession, d: str) -> DataFrame:
    return K.summarise(_papers(s, d))


@query("SELECT DISTINCT doc_id, printf('%.4f', year / 7.0) AS fixed, printf('%.1f%%', coalesce(len(authors), 0) / 17.0 * 100) AS share FROM papers WHERE year IS NOT NULL")
def number_formats(s: SparkSession, d: str) -> DataFrame:
    p = _papers(s, d).where("year is not null")
    return p.select("doc_id", X.fixed_digits(F.col("year") / 7.0).alias("fixed"), X.percent(F.greatest(F.coalesce(F.size("authors"), F.lit(0)), F.lit(0)) / 17.0).alias("share")).distinct()
