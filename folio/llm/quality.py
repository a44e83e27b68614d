"""Text statistics of documents and outlier scores from exact per-language ranks.

First pass: in how many documents of a language a word stands; words in at least ``COMMON`` of them
are its common words (function words, in the main). Second pass: the statistics of each document.

The values of each statistic, as computed, are then ranked per language: equal values are
counted together, the distinct values are partitioned by range and sorted within partitions, and each
partition's offset is the sum of the counts before it, so ranks are exact without one task sorting a
language. A rank gives the empirical tail probability of a value on the side where junk lies, and a
document's score is the weighted sum of the negative logarithms of its tails.

Tails are taken among the documents of the language that look like prose, so that junk which is common
does not pass for normal: at first those with a ``prose_share`` of at least ``PROSE``, in a second round those
whose first score is below ``SCORE``. A language's tail is drawn to that of all languages by ``PRIOR`` documents'
weight, so that a language of one document has a score too. ``p8_found`` takes the scores of at least ``SCORE``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.sentences import language
from folio.session import Scratch

COMMON = 0.1
PROSE = 0.5  # share of running prose of the documents that the first tails are taken among
PRIOR = 50.0  # documents of a language that the tails of all languages weigh as much as
CAP = 10.0  # most that one tail counts: about one document in 22,000
SCORE = 28.0  # least score of what is not prose; one statistic alone does not reach it
OFTEN = 0.001  # values that a greater share of a language's documents has are joined by broadcast: at most 1 / OFTEN for a statistic

#: name, the side of junk ("high" or "low"), the unit that p8_statistics shows (ranks are of the values as computed), the weight
STATISTICS = (
    ("mean_word_length", "high", 0.01, 1.0), ("symbol_ratio", "high", 0.0001, 1.0), ("digit_ratio", "high", 0.0001, 1.0), ("punctuated_lines", "low", 0.0001, 1.0),
    ("common_words", "low", 0.0001, 1.0), ("repeated_runs", "high", 0.0001, 1.0), ("stray_stops", "high", 0.0001, 2.5), ("prose_share", "low", 0.0001, 2.0),
)
LONGEST = float("inf")  # mean word lengths are ranked without a bound

_DENSE = re.compile("[฀-໿぀-ヿ㐀-鿿]")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*|[฀-໿぀-ヿ㐀-鿿]")
_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()\-’“”„«»‘。、，；：！？「」『』（）“”…।؟،؛¿¡%̀-ͯऀ-ॿ฀-๿؀-ۿ]")
_DIGIT = re.compile(r"\d")
_ENDS = tuple(".!?…。！？।؟:;\"”’»」)")
_STOP = re.compile(r"(?:[.!?…]+[\"”’»)]*(?=\s|$)|[。！？।؟]+[\"”’»」)）]*)")
_MARK = re.compile(r"\s*(?:[-*•–·‣▪]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])\s+")
_PARAGRAPH = re.compile(r"\n\s*\n")
_LANGS = {"en", "de", "fr", "es", "it", "pt", "nl", "ru", "ar", "hi", "th", "ja", "zh", "ko", "el", "he"}


def group_of(text: str, stated: str | None) -> str:
    """The language a document is ranked in: told from its text; where the text has no function words,
    the stated one; else the most common of Latin script."""
    told = language(text, text.lower().split())
    if told != "latin":
        return told
    stated = (stated or "").strip().lower()[:2]
    return stated if stated in _LANGS and stated not in ("ru", "ar", "hi", "th", "ja", "zh", "ko", "el", "he") else "en"


def _tokens(text: str) -> list[str]:
    """Words as ranked and compared; letters of scripts without spaces one by one."""
    if text.isascii():
        return text.lower().split()
    return _DENSE.sub(r" \g<0> ", text.lower()).split()


_EDGE = "\"'“”„«»‚‘’()[]{}<>*.,;:!?…。、，；：！？「」（）।؟،¿¡"


def _words(text: str) -> list[str]:
    return [w for w in (t.strip(_EDGE) for t in _tokens(text)) if w]


_PLAIN_SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789 \t\n\r\v\f\x1c\x1d\x1e\x1f_.,;:!?'\"()-%"
_NO_DIGITS = bytes(set(range(128)) - set(b"0123456789"))
_STRAY = re.compile(r"[.!?] [^\W\d_]{2}")
_REFERENCE = re.compile(r"\s*\[\d{1,4}\]\s+\S")


def _signs(text: str) -> tuple[int, int]:
    """(symbols, digits) of a text."""
    if text.isascii():
        raw = text.encode("ascii")
        return len(raw.translate(None, _PLAIN_SIGNS)), len(raw.translate(None, _NO_DIGITS))
    return len(_SYMBOL.findall(text)), len(_DIGIT.findall(text))


def _stray_stops(text: str, n_words: int) -> float:
    """Share of the words that end with a stop and are followed by a word in lower case; 0 in scripts
    without capitals and in texts that have hardly any."""
    found = [m.group() for m in _STRAY.finditer(text) if text[max(0, m.start() - 4) : m.start()].isalpha()]
    if not found:
        return 0.0
    stray = sum([m[-2:].islower() for m in found])
    return stray / n_words if stray < len(found) or any(map(str.isupper, text)) else 0.0


def _line(s: str, common: set[str], seen: Counter) -> tuple[tuple, list[str]]:
    """What ``_prose_parts`` looks at, and the words."""
    tokens = _tokens(s)
    size = sum(map(len, s.split()))
    words = [w for w in [t.strip(_EDGE) for t in tokens] if w]
    known = sum(map(common.__contains__, words))
    plain = sum([w.isalpha() or not w.isascii() or w.replace("-", "").replace("'", "").isalpha() for w in words])
    signs = sum(map(s.count, (",", ";", "|", "=", ">", "\t", "   ")))
    stops = len(_STOP.findall(s))
    run = sum([len(t) for t in tokens if len(t) > 28]) * 2 > size
    entry = bool(_REFERENCE.match(s)) or bool(_MARK.match(s)) and (len(words) < 8 or not s.rstrip().endswith(_ENDS))
    return (size, len(tokens), known, plain, signs, stops, len(set(words)), run or entry or (seen[s.strip()] > 2 and len(tokens) > 5)), words


def _prose_parts(text: str, common: set[str]) -> tuple[int, int, list[str]]:
    """(characters in running prose, all characters), white space not counted, and the words. A line is
    judged together with its neighbours in the paragraph, up to some 30 tokens."""
    prose = total = 0
    every: list[str] = []
    for paragraph in _PARAGRAPH.split(text):
        lines = [s for s in paragraph.split("\n") if s.strip()]
        seen = Counter(map(str.strip, lines))
        rows = []
        for s in lines:
            row, words = _line(s, common, seen)
            rows.append(row)
            every += words
        for i, row in enumerate(rows):
            total += row[0]
            if row[7]:
                continue
            lo = hi = i
            width = row[1]
            while width < 30 and (lo > 0 or hi < len(rows) - 1):
                if lo > 0:
                    lo -= 1
                    width += rows[lo][1]
                if hi < len(rows) - 1:
                    hi += 1
                    width += rows[hi][1]
            near = [r for r in rows[lo : hi + 1] if not r[7]]
            n, known, plain, signs, stops, kinds = map(sum, zip(*[r[1:7] for r in near]))
            if known >= 0.2 * n > 0 and plain >= 0.6 * n and signs <= 0.3 * n and (stops or len(near) == 1 and (n < 30 or signs < 0.1 * n)) and kinds >= min(0.35 * n, 20):
                prose += row[0]
    return prose, total, every


def statistics_of(text: str, common: set[str]) -> list[float]:
    """The values of ``n_words`` and of ``STATISTICS``: counts and ratios of counts, not rounded."""
    prose, total, words = _prose_parts(text, common)
    n = len(words)
    size = total or 1
    lines = [s.rstrip() for s in text.split("\n") if s.strip()]
    n_runs = max(0, n - 3)
    symbols, digits = _signs(text)
    return [
        float(n),
        sum(map(len, words)) / n if n else 0.0,
        symbols / size,
        digits / size,
        sum([s.endswith(_ENDS) for s in lines]) / len(lines) if lines else 0.0,
        sum(map(common.__contains__, words)) / n if n else 0.0,
        (n_runs - len(set(zip(words, words[1:], words[2:], words[3:])))) / n_runs if n_runs else 0.0,
        _stray_stops(text, n) if n else 0.0,
        prose / total if total else 0.0,
    ]


_NAMES = ["n_words", *(s[0] for s in STATISTICS)]


def common_words(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``lang``, ``word``: the words in at least ``COMMON`` of a language's documents; as a document
    has so many different words, a language has at most its mean of them / ``COMMON``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        size = 0

        def out() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
            a, b, c = zip(*rows) if rows else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.int64())], ["lang", "word", "n"])

        for batch in batches:
            for text, stated in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text and not text.isspace():
                    c = counts.setdefault(group_of(text, stated), Counter())
                    c.update({*_words(text), "\n"})
                    size += len(text)
            if size > 20_000_000:
                yield out()
                counts, size = {}, 0
        yield out()

    narrow = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("stated")).where("text is not null")
    counts = narrow.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = Scratch(docs.sparkSession).write(counts, "wordcounts")
    total = counts.where(F.col("word") == "\n").select("lang", F.col("n").alias("docs"))
    return counts.where(F.col("word") != "\n").join(F.broadcast(total), "lang").where((F.col("n") >= F.col("docs") * COMMON) & F.col("word").rlike(r"^[\p{L}\p{M}'’-]+$")).select("lang", "word")


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id``, ``lang`` (see ``group_of``), ``n_words`` and ``STATISTICS`` of every row. Null, empty and
    blank texts have null statistics and language; repeated rows stay; empty tables give none."""
    spark = docs.sparkSession
    known: dict[str, set[str]] = {}
    for r in common_words(docs, text_col, lang_col).collect():  # bounded, see common_words
        known.setdefault(r.lang, set()).add(r.word)
    sent = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, values = [], []
            for text, stated in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if text and not text.isspace():
                    lang = group_of(text, stated)
                    langs.append(lang)
                    values.append(statistics_of(text, sent.value.get(lang, set())))
                else:
                    langs.append(None)
                    values.append([None] * len(_NAMES))
            columns = list(zip(*values)) if values else [[]] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), *(pa.array(c, pa.float64()) for c in columns)], ["id", "lang", *_NAMES])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("stated"))
    kind = docs.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, lang string, " + ", ".join(f"{n} double" for n in _NAMES))


def exact_ranks(counted: DataFrame, scratch: Scratch, by: tuple[str, ...] = ("lang", "stat")) -> DataFrame:
    """``counted``: distinct (``by``, value) with a weight ``n``. For each ``below`` and ``upto``, the weight of
    lesser and of at most equal values, and ``total``. Partitions are ranges; offsets are the sums of those before."""
    keys = list(by)
    ordered = counted.repartitionByRange(*keys, "value").sortWithinPartitions(*keys, "value").withColumn("part", F.spark_partition_id())
    ordered = scratch.write(ordered, "ordered")
    sums = ordered.groupBy("part", *keys).agg(F.sum("n").alias("size"))  # a row for each partition and group it holds
    run = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("size").over(run), F.lit(0))).withColumn("total", F.sum("size").over(Window.partitionBy(*keys))).drop("size")
    inside = Window.partitionBy("part", *keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ordered.withColumn("cum", F.sum("n").over(inside)).join(offsets, ["part", *keys])
    return ranked.select(*keys, "value", (F.col("offset") + F.col("cum") - F.col("n")).alias("below"), (F.col("offset") + F.col("cum")).alias("upto"), "total")


def _values(table: DataFrame, like_prose: F.Column) -> DataFrame:
    """``row``, ``lang``, ``n`` (1 for what tails are taken among), ``stat`` (place in ``STATISTICS``) and ``value``."""
    values = F.array(*[F.col(s[0]) for s in STATISTICS])
    return table.where("lang is not null").select("row", "lang", like_prose.cast("long").alias("n"), F.posexplode(values).alias("stat", "value"))


def _parts(values: DataFrame, scratch: Scratch) -> DataFrame:
    """``lang``, ``stat``, ``value``, ``part`` (of the score) of every distinct value, and ``often``, see ``OFTEN``."""
    counts = scratch.write(values.groupBy("lang", "stat", "value").agg(F.sum("n").alias("n"), F.count("*").alias("docs")), "counts")
    high = F.array(*[F.lit(s[1] == "high") for s in STATISTICS])[F.col("stat")]
    beyond = F.when(high, F.col("total") - F.col("below")).otherwise(F.col("upto"))
    pooled = exact_ranks(counts.groupBy("stat", "value").agg(F.sum("n").alias("n")), scratch, ("stat",))
    pooled = pooled.select("stat", "value", F.coalesce(F.try_divide(beyond, F.col("total")), F.lit(0.0)).alias("all"))
    own = exact_ranks(counts.drop("docs"), scratch).select("lang", "stat", "value", beyond.alias("beyond"), "total")
    tail = (F.col("beyond") + PRIOR * F.col("all")) / (F.col("total") + PRIOR)
    weight = F.array(*[F.lit(s[3]) for s in STATISTICS])[F.col("stat")]
    part = weight * F.least(F.lit(CAP), -F.ln(F.greatest(tail, F.lit(1e-9))))
    size = counts.groupBy("lang", "stat").agg(F.sum("docs").alias("size"))  # a row for each language and statistic
    often = counts.join(F.broadcast(size), ["lang", "stat"]).where(F.col("docs") > F.col("size") * OFTEN).select("lang", "stat", "value", F.lit(True).alias("often"))
    parts = own.join(pooled, ["stat", "value"]).join(F.broadcast(often), ["lang", "stat", "value"], "left")
    return scratch.write(parts.select("lang", "stat", "value", part.alias("part"), F.coalesce("often", F.lit(False)).alias("often")), "parts")


def _scored(table: DataFrame, values: DataFrame, parts: DataFrame) -> DataFrame:
    keys = ["lang", "stat", "value"]
    often, seldom = F.broadcast(parts.where("often").drop("often")), parts.where("not often").drop("often")
    each = values.join(often, keys).select("row", "part").union(values.join(often, keys, "left_anti").join(seldom, keys).select("row", "part"))
    return table.join(each.groupBy("row").agg(F.round(F.sum("part"), 6).alias("score")), "row", "left")


def outlier_scores(stats: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``stats`` with ``score``: the weighted sum over ``STATISTICS`` of -ln(share of its language's prose that lies
    at least as far on the side of junk), see the module's text; null where the statistics are."""
    scratch = scratch or Scratch(stats.sparkSession)
    table = scratch.write(stats.drop("score").withColumn("row", F.monotonically_increasing_id()), "stats")
    values = _values(table, F.col("prose_share") >= PROSE)
    first = scratch.write(_scored(table, values, _parts(values, scratch)), "first")
    values = _values(first, F.col("score") < SCORE)
    return _scored(table, values, _parts(values, scratch)).select(*stats.drop("score").columns, "score")


def not_prose(scored: DataFrame) -> DataFrame:
    """The rows of ``outlier_scores`` that are for the most part no running prose."""
    return scored.where(F.col("score") >= SCORE)
