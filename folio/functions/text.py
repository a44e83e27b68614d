"""Text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"
# Abbreviations that a sentence does not end at, and acronyms with their expansions.
ABBREVIATIONS = ("e.g.", "i.e.", "et al.", "Fig.", "Figs.", "cf.", "vs.", "approx.", "Dr.", "Prof.", "No.", "Eq.", "Sect.", "Suppl.", "Inst.", "ref.")
ACRONYMS = {"ad": ["alzheimer", "disease"], "mri": ["magnetic", "resonance", "imaging"], "mci": ["mild", "cognitive", "impairment"], "pet": ["positron", "emission", "tomography"], "csf": ["cerebrospinal", "fluid"], "rag": ["retrieval", "augmented", "generation"]}
SECTIONS = ("Background", "Introduction", "Objective", "Aim", "Methods", "Results", "Findings", "Discussion", "Conclusions", "Conclusion", "Interpretation", "Funding", "Scope", "Approach", "Design")


def strip(c: Column) -> Column:
    """Without white space at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def truncate(c: Column, n: int) -> Column:
    """At most ``n`` characters, the mark included; shorter texts are unchanged."""
    cut = F.concat(F.regexp_replace(F.substring(c, 1, max(0, n - 6)), r"\s+$", ""), F.lit(" [...]"))
    return F.when(F.length(c) <= n, c).otherwise(cut if n >= 6 else F.substring(c, 1, n))


def clean_markup(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"</?[a-zA-Z][^<>]*>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return normalize_whitespace(c)


def split_sentences(c: Column) -> Column:
    """Array of sentences; listed abbreviations and decimals do not end one. Null for null."""
    for a in ABBREVIATIONS:
        c = F.replace(c, F.lit(a), F.lit(a.replace(".", "\u0002")))
    marked = F.regexp_replace(c, r"([.!?])\s+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: strip(F.replace(s, F.lit("\u0002"), F.lit(".")))), lambda s: s != "")


MARKER = r"\[[0-9]+(?:\s*,\s*[0-9]+)*\]"


def claims(c: Column) -> Column:
    """Sentences of an answer; markers that follow a sentence's stop belong to that sentence."""
    return split_sentences(F.regexp_replace(c, rf"([.!?])\s+({MARKER}(?:\s*{MARKER})*)", " $2$1"))


def tokens(c: Column, expand: bool = False) -> Column:
    """Lower-case terms; hyphenated ones whole and in parts; acronyms with their expansions."""
    words = F.regexp_extract_all(F.lower(c), F.lit(f"({TERM})"), 1)
    words = F.flatten(F.transform(words, lambda t: F.when(F.contains(t, F.lit("-")), F.concat(F.array(t), F.split(t, "-"))).otherwise(F.array(t))))
    if expand:
        table = F.create_map(*[x for k, v in ACRONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
        none = F.array().cast("array<string>")
        words = F.flatten(F.transform(words, lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(table, t), none))))
    return words


def stable_hash(*parts: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, length)


def author_list(authors: Column, most: int = 3) -> Column:
    """The first names joined, " et al." if there are more; "Unknown" for none. Null names are left out."""
    known = F.filter(authors, lambda a: a.isNotNull())
    more = F.when(F.size(known) > most, F.lit(" et al.")).otherwise(F.lit(""))
    return F.when(F.coalesce(F.size(known), F.lit(0)) <= 0, F.lit("Unknown")).otherwise(F.concat(F.array_join(F.slice(known, 1, most), ", "), more))


def bare_id(c: Column) -> Column:
    """An id without its prefix up to the first colon; the whole id without a colon."""
    return F.regexp_replace(c, r"^[^:]*:", "")


def tag_union(a: Column, b: Column) -> Column:
    """Sorted distinct tags of both; nulls are left out, null arrays count as empty."""
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce(a, none), F.coalesce(b, none))
    return F.array_sort(F.array_distinct(F.filter(both, lambda t: t.isNotNull())))


def landing_url(url: Column, doi: Column) -> Column:
    """The url; for a null or empty one the DOI's; null without either."""
    filled = lambda c: F.when(c != "", c)
    return F.coalesce(filled(url), F.concat(F.lit("https://doi.org/"), filled(doi)))


def fixed_digits(c: Column, digits: int = 4) -> Column:
    """A number with so many digits after the point, no groups; "n/a" for null."""
    return F.when(c.isNull(), "n/a").otherwise(F.format_string(f"%.{digits}f", c.cast("double")))


def percent(c: Column) -> Column:
    """A share as a percentage with one digit; "n/a" for null."""
    return F.when(c.isNull(), "n/a").otherwise(F.format_string("%.1f%%", c.cast("double") * 100))


def sections_of(c: Column) -> Column:
    """Sections of a text as (pos, heading, body): markdown headings, or listed names followed by a
    colon or glued to a capital, at the start or after a sentence end; else one "Abstract"."""
    names = "|".join(sorted(SECTIONS, key=lambda s: (-len(s), s)))
    md = F.regexp_replace(c, r"(?m)^#{1,6}[ \t]+(.+)$", "\u0001$1\u0002")
    plain = F.regexp_replace(c, rf"(^|[.!?]\s*|\n)({names})(?::\s*|([A-Z]))", "$1\u0001$2\u0002$3")
    marked = F.when(F.contains(md, F.lit("\u0001")), md).otherwise(plain)
    parts = F.filter(F.split(marked, "\u0001"), lambda p: F.contains(p, F.lit("\u0002")))
    found = F.transform(parts, lambda p, i: F.struct(i.alias("pos"), F.initcap(strip(F.substring_index(p, "\u0002", 1))).alias("heading"), strip(F.substring_index(p, "\u0002", -1)).alias("body")))
    whole = F.array(F.struct(F.lit(0).alias("pos"), F.lit("Abstract").alias("heading"), c.alias("body")))
    return F.when(c.isNull(), F.lit(None)).when(F.size(found) > 0, found).otherwise(whole)


def markers(c: Column) -> Column:
    """Distinct citation numbers in the order in which they are first seen."""
    groups = F.regexp_extract_all(c, F.lit(r"\[([0-9]+(?:\s*,\s*[0-9]+)*)\]"), 1)
    return F.array_distinct(F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*"))), lambda n: n.cast("int")))
