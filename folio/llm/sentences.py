"""Sentence units of texts in any script, with statistics learned from the corpus itself.

First pass: per language, count words with and without a final period and the words that follow
periods. Log-likelihood ratios (Dunning) on these counts give abbreviations (a short word that
nearly always has a period), collocations across a period (an ordinal and its month) and words that
start sentences. Nothing is labelled and nothing is listed beforehand; the language of a text is told
from its script and, in Latin script, from its function words.

Second pass: a blank line, a heading line or a list mark ends a unit; within a block every possible
end is classified with the statistics: a period after an abbreviation, an initial or a number ends a
sentence only where a known sentence starter follows, and a word that is mostly followed by a number ("No. 3") no
sentence before one. Scripts with signs of their own end at them;
Thai sentences end at spaces between Thai letters. Closing quotes, brackets and tags stay with the
unit they close; a quote whose sentence goes on does not end it.

Scale: both passes map whole texts; only the counts are shuffled, combined per batch before. A word needs
``LEAST`` occurrences to be judged, whatever the size of the corpus. The learned lists are sent to executors after
a check of their number; beyond ``MOST_ENTRIES`` ``split`` asks for a greater ``least``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.session import Scratch

LEAST = 2  # occurrences from which on a word is judged
MOST_ENTRIES = 3_000_000  # of the model, some 100 bytes each
ABBREVIATION = 0.3
COLLOCATION = 7.88
NUMBERED = 0.3  # share of a word's periods that are followed by a number
STARTER = 30.0
ENDING = 0.5
COMMON = 0.6  # share in lower case of words whose capital tells a sentence's beginning
LONGEST_ABBREVIATION = 12

_SCRIPTS = {
    "ru": re.compile("[Ѐ-ӿ]"), "ar": re.compile("[؀-ۿ]"), "hi": re.compile("[ऀ-ॿ]"), "th": re.compile("[฀-๿]"),
    "ja": re.compile("[぀-ヿ]"), "zh": re.compile("[㐀-鿿]"), "ko": re.compile("[가-힯]"), "el": re.compile("[Ͱ-Ͽ]"), "he": re.compile("[֐-׿]"),
}
# Frequent function words by which languages in Latin script are told apart.
_FUNCTION_WORDS = {
    "en": "the of and in to was with for were that by from",
    "de": "der die das und wurde war mit nicht ist von den im bei eine zu",
    "fr": "le les et la des est une du dans au sur que pour ont été",
    "es": "el los las en la del se una que por con para fue",
    "it": "il gli che di della per con una non sono nel",
    "pt": "os da do em uma que não com para foi",
    "nl": "het een en van werd niet met voor op zijn",
}
_BY_WORD: dict[str, list[str]] = {}
for _lang, _list in _FUNCTION_WORDS.items():
    for _w in _list.split():
        _BY_WORD.setdefault(_w, []).append(_lang)


def language(text: str, tokens: list[str]) -> str:
    if not text.isascii():
        counts = {k: len(p.findall(text)) for k, p in _SCRIPTS.items()}
        best = max(counts, key=counts.get)
        if counts["ja"] * 8 > counts["zh"] and counts["ja"]:
            counts["ja"] += counts["zh"]
            best = max(counts, key=counts.get)
        if counts[best] * 4 > sum(map(str.isalpha, text)):
            return best
    votes: Counter = Counter()
    kinds: Counter = Counter()
    for w, n in Counter(filter(_BY_WORD.__contains__, tokens)).items():
        for lang in _BY_WORD[w]:
            votes[lang] += n
            kinds[lang] += 1
    votes = Counter({lang: n for lang, n in votes.items() if kinds[lang] > 1})
    if not votes:
        return "latin"
    best, n = votes.most_common(1)[0]
    return best if n * 20 >= len(tokens) else "latin"


_EDGE = "\"'“”„«»‚‘’()[]{}<>*¿¡—–"
_NUMBER = re.compile(r"^[+\-−]?\d+(?:[.,:]\d+)*$")


def _type(token: str) -> str:
    """A token without edges and final period; numbers are one type."""
    t = token.strip(_EDGE).lower()
    t = t.rstrip(".") if not t.endswith("..") else ""
    return "##" if _NUMBER.match(t) else t


_IDEOGRAPHS = re.compile("[\u3000-\u30ff\u3400-\u9fff\uff00-\uffef]+")  # no words to count: they have no spaces or periods


class Counts:
    """Counts of one batch, by language."""

    def __init__(self) -> None:
        self.tokens: dict[str, Counter] = {}
        self.pairs: dict[str, Counter] = {}

    def add(self, text: str) -> None:
        tokens = text.split()
        low = text.lower().split()
        lang = language(text, low)
        if lang in ("ja", "zh"):
            tokens = _IDEOGRAPHS.sub(" ", text).split()
        self.tokens.setdefault(lang, Counter()).update(tokens)
        ends = [(a, b) for a, b in zip(tokens, tokens[1:]) if a[-1] == "."]
        if ends:
            self.pairs.setdefault(lang, Counter()).update(ends)

    def rows(self) -> Iterator[tuple[str, str, str | None, int, int, int]]:
        """(language, word, next word or null, with period, without period, in lower case)."""
        for lang, counts in self.tokens.items():
            merged: dict[str, list[int]] = {}
            for token, n in counts.items():
                core = token.strip(_EDGE).rstrip(",;:")
                kind = _type(core)
                if kind and len(kind) <= 40:
                    entry = merged.setdefault(kind, [0, 0, 0])
                    entry[0 if core.endswith(".") else 1] += n
                    entry[2] += n * core[0].islower()
            for kind, entry in merged.items():
                yield lang, kind, None, *entry
        for lang, counts in self.pairs.items():
            joined: Counter = Counter()
            for (a, b), n in counts.items():
                kind, follower = _type(a), _type(b.rstrip(",;:"))
                if follower and len(follower) <= 40:
                    joined[kind if len(kind) <= LONGEST_ABBREVIATION else "", follower] += n
            for (kind, follower), n in joined.items():
                yield lang, kind, follower, n, 0, 0


_COUNTS = "lang string, word string, follower string, n long, plain long, low long"


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, size = Counts(), 0

    def out() -> pa.RecordBatch:
        columns = list(zip(*counts.rows())) or [[]] * 6
        kinds = [pa.string()] * 3 + [pa.int64()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "word", "follower", "n", "plain", "low"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                counts.add(text)
                size += len(text)
        if size > 30_000_000:  # bounds a worker's memory; counts are summed later
            yield out()
            counts, size = Counts(), 0
    yield out()


def _ratio(pair: str, first: str, second: str, total: str) -> F.Column:
    """Dunning's log-likelihood ratio that ``second`` is likelier after ``first`` than elsewhere."""
    k1, n1 = F.col(pair).cast("double"), F.col(first).cast("double")
    k2, n2 = F.col(second).cast("double") - k1, F.col(total).cast("double") - n1

    def like(k: F.Column, n: F.Column, p: F.Column) -> F.Column:
        safe = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
        return k * F.ln(safe) + (n - k) * F.ln(1 - safe)

    p = (k1 + k2) / (n1 + n2)
    return 2 * (like(k1, n1, k1 / n1) + like(k2, n2, k2 / n2) - like(k1, n1, p) - like(k2, n2, p))


def learn(texts: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``lang``, ``kind`` (abbreviation, collocation, starter, common), ``word``, ``follower`` (null but for
    collocations) and ``score``, from the words that occur ``least`` times. Null and empty texts add nothing."""
    scratch = Scratch(texts.sparkSession)
    raw = texts.select(F.col(text_col).alias("text")).where("text is not null").mapInArrow(_count_batches, _COUNTS)
    counts = scratch.write(raw.groupBy("lang", "word", "follower").agg(F.sum("n").alias("n"), F.sum("plain").alias("plain"), F.sum("low").alias("low")), "counts")
    types = counts.where("follower is null").withColumn("all", F.col("n") + F.col("plain"))
    total = types.groupBy("lang").agg(F.sum("all").alias("total"), F.sum("n").alias("periods"))
    rated = types.join(F.broadcast(total), "lang").where(F.col("all") >= least)  # a row for each language

    dots = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    letters = F.length("word") - dots
    p = F.least(F.col("periods") / F.col("total"), F.lit(0.98))
    gain = 2 * (F.col("n") * F.ln(F.lit(0.99)) + F.col("plain") * F.ln(F.lit(0.01)) - F.col("n") * F.ln(p) - F.col("plain") * F.ln(1 - p))
    score = gain * F.exp(-letters) * (dots + 1) * F.pow(letters.cast("double"), -F.col("plain").cast("double"))
    abbreviations = (
        rated.where((F.col("n") > 0) & F.col("word").rlike(r"^[\p{L}\p{M}]+(?:[.’'-][\p{L}\p{M}]+)*$") & (letters <= LONGEST_ABBREVIATION) & (letters > 0))
        .withColumn("score", score)
        .where(F.col("score") >= ABBREVIATION)
        .select("lang", F.lit("abbreviation").alias("kind"), "word", F.lit(None).cast("string").alias("follower"), "score")
    )
    abbreviations = scratch.write(abbreviations, "abbreviations")

    pairs = counts.where("follower is not null").select("lang", "word", "follower", F.col("n").alias("k"))
    single = (F.length("word") == 1) | (F.col("word") == "##")
    ends = pairs.join(abbreviations.select("lang", "word"), ["lang", "word"], "left_anti").where(~single | (F.col("word") == ""))
    breaks = ends.groupBy("lang").agg(F.sum("k").alias("breaks"))
    after = ends.groupBy("lang", F.col("follower").alias("word")).agg(F.sum("k").alias("k"))
    starters = (
        after.join(rated.select("lang", "word", "all", "total"), ["lang", "word"])
        .join(F.broadcast(breaks), "lang")
        .where((F.col("k") * F.col("total") > F.col("all") * F.col("breaks")) & (F.col("breaks") < F.col("total")) & F.col("word").rlike(r"\p{L}"))
        .withColumn("score", _ratio("k", "breaks", "all", "total"))
        .where(F.col("score") >= STARTER)
        .select("lang", F.lit("starter").alias("kind"), "word", F.lit(None).cast("string").alias("follower"), "score")
    )
    # A short word that closes sentences much more often than it is found inside looks like an
    # abbreviation; it is none if nearly all that follows it are starters.
    begun = pairs.join(abbreviations.select("lang", "word"), ["lang", "word"], "left_semi").join(starters.select("lang", F.col("word").alias("follower"), F.lit(1).alias("starts")), ["lang", "follower"], "left")
    ending = begun.groupBy("lang", "word").agg(F.sum("k").alias("k"), F.coalesce(F.sum(F.when(F.col("starts") == 1, F.col("k"))), F.lit(0)).alias("s")).where(F.col("s") > F.col("k") * ENDING)
    abbreviations = abbreviations.join(ending.select("lang", "word"), ["lang", "word"], "left_anti").select("lang", "kind", "word", "follower", "score")
    known = rated.select("lang", "word", "all", "total")
    collocations = (
        pairs.where(single & F.col("follower").rlike(r"\p{L}"))
        .join(known.withColumnRenamed("all", "first"), ["lang", "word"])
        .join(known.select("lang", F.col("word").alias("follower"), F.col("all").alias("second")), ["lang", "follower"])
        .where((F.col("k") > 1) & (F.col("first") < F.col("total")) & (F.col("k") * F.col("total") > F.col("first") * F.col("second")))
        .withColumn("score", _ratio("k", "first", "second", "total"))
        .where(F.col("score") >= COLLOCATION)
        .select("lang", F.lit("collocation").alias("kind"), "word", "follower", "score")
    )
    numbered = (
        pairs.where(~single & (F.col("follower") == "##") & (F.col("word") != ""))
        .join(rated.select("lang", "word", F.col("all").alias("first"), F.col("n").alias("stops"), "total"), ["lang", "word"])
        .join(known.where("word = '##'").select("lang", F.col("all").alias("second")), "lang")
        .where((F.col("k") > 1) & (F.col("k") >= F.col("stops") * NUMBERED) & (F.col("first") < F.col("total")) & (F.col("k") * F.col("total") > F.col("first") * F.col("second")))
        .withColumn("score", _ratio("k", "first", "second", "total"))
        .where(F.col("score") >= COLLOCATION)
        .select("lang", F.lit("collocation").alias("kind"), "word", "follower", "score")
    )
    common = rated.where((F.col("low") >= F.col("all") * COMMON) & F.col("word").rlike(r"^\p{Ll}{2}")).select("lang", F.lit("common").alias("kind"), "word", F.lit(None).cast("string").alias("follower"), (F.col("low") / F.col("all")).alias("score"))
    return scratch.write(abbreviations.union(starters).union(collocations).union(numbered).union(common), "model")


# Signs.
_CLOSE = r"[)\]}\"'”’»›」』】）〕］》〉*_]"
_OPEN = r"[(\[{\"'“‘„‚«‹「『【（〔［《〈¿¡*_]"
_CANDIDATE = re.compile(
    rf"(?P<own>[。！？｡．।॥؟۔]+|…{{2,}})(?P<shut>(?:{_CLOSE}|</[a-zA-Z][^<>]*>)*)"
    rf"|(?P<mark>[.!?…‽]+)(?P<close>(?:[   ]?[»›]|{_CLOSE}|“(?=[\s,;:.]|$)|</[a-zA-Z][^<>]*>)*)(?=\s|$|[A-ZÀ-ÖØ-Þ\"“„«¿¡]|[぀-鿿])"
    r"|(?<=[ก-๛])(?:[  \t]+|[  \t]*\n[  \t]*)(?=[ก-๛])"
)
_AHEAD = re.compile(rf"\s*(?:{_OPEN}|<[a-zA-Z][^<>]*>|\s)*(?P<word>[\w.]*)")
_BLANK = re.compile(r"(?:\r\n|[\n\r\v\f\x85  ])[^\S\n\r]*(?:\r\n|[\n\r\v\f\x85  ])\s*|[ \f]\s*")
_LINE = re.compile(r"[\n\r\v\x85 ]+")
_MARK = re.compile(r"[^\S\n]*(?:(?P<dot>[-*•–·‣◦▪●○■□✓➢—])|\(?(?P<num>\d{1,3})[.):]|\(?(?P<let>[a-zA-Z])[.)])[^\S\n]+(?=\S)")
_SPEECH_ZH = re.compile(r"[^。！？，；“”\n]{1,14}?(?:问道|問道|说道|說道|问|問|说|說|道|答|喊|写道|寫道|表示)[。！？，：]")
_SPEECH_HI = re.compile(r"\s*[^।?!\n]{0,40}(?:पूछा|कहा|बोल[ाे]|लिखा)\s*[।,]")
_SPEECH_AR = re.compile(r"\s*(?:سأل|قال|كتب|أضاف|تساءل|أجاب|هتف)\w*")
_SPEECH_TH = re.compile(r"\s*[^\s]{0,30}(?:ถาม|กล่าว|พูด|บอก)")


class Splitter:
    """Classifies the possible ends of one language."""

    def __init__(self, lang: str, abbreviations: set[str], starters: set[str], collocations: set[tuple[str, str]], common: frozenset[str] | set[str] = frozenset()):
        """``starters``: words that start sentences; ``common``: words whose capital tells of a start."""
        self.lang, self.abbreviations, self.starters, self.collocations, self.common = lang, abbreviations, starters, collocations, common

    def _goes_on(self, text: str, m: re.Match, closed: str) -> bool:
        """Whether the sentence goes on after its quoted part; the script that follows tells the language."""
        rest = text[m.end() : m.end() + 60]
        if closed and closed[-1] in "」』" and rest.startswith(("と", "って", "という", "などと")):
            return True
        if not closed or not any(c in "”」』\"»" for c in closed):
            return False
        if _SPEECH_ZH.match(rest):
            return True
        return m.group(0)[0] in "?!؟" and any(p.match(rest) for p in (_SPEECH_HI, _SPEECH_AR, _SPEECH_TH))

    def is_end(self, text: str, m: re.Match, lower_only: bool) -> bool:
        own, mark = m.group("own"), m.group("mark")
        if own is None and mark is None:
            return True  # a space between Thai letters
        end = m.end()
        ahead = _AHEAD.match(text, end)
        word = ahead.group("word")
        rest = text[ahead.end("word") if word else ahead.end() : ahead.end() + 1]
        if not word and rest in tuple(",;:，、；：)]}）」』”»%"):
            return False
        if own is not None:
            return not self._goes_on(text, m, m.group("shut"))
        if end >= len(text):
            return True
        closed = m.group("close")
        glued = not text[end].isspace()
        before = text[max(0, m.start() - 40) : m.start()]
        before = before[max(before.rfind(c) for c in " \n\t\r  　") + 1 :]
        before = before[max((x.end() for x in _IDEOGRAPHS.finditer(before)), default=0) :]
        kind = _type(before.strip(_EDGE) + ".") if mark == "." else ""
        if glued:
            first = text[end]
            if closed and first in "\"“„«¿¡":
                pass
            elif first in "\"“„«¿¡":
                if mark == "." and not before[-2:].isalpha():
                    return False
            elif "぀" <= first <= "鿿":
                return mark != "."
            else:
                plain = before.strip(_EDGE)
                if not (plain.replace("-", "").isalpha() and plain[-1:].islower() and len(plain) > 1 or plain[-1:] in "%)" or _NUMBER.match(plain) and len(word) > 2) or kind in self.abbreviations:
                    return False
                if not (len(word) == 1 and text[end + 1 : end + 2].isspace() or word[1:2].islower()) or "." in word.rstrip("."):
                    return False
        letter = word[:1]
        if letter.islower() and not lower_only:
            # names such as mRNA or iPSC begin sentences too, and known starters that are no plain words
            token = text[ahead.start("word") : ahead.start("word") + 40].split(None, 1)[0]
            odd = re.match(r"[a-z]{1,2}[A-Z]{2}", word) or not token.rstrip(".,;:").isalpha() and _type(token.rstrip(",;:")) in self.starters
            if not (mark in (".", "!", "?") and odd and kind not in self.abbreviations):
                return False
        if letter.islower() and set(mark) & set("?!") and any(c in "\"”»“" for c in closed) and not set(text[end : ahead.start("word")]) & set("\"“„«‘"):
            return False  # in a text without capitals: a quote followed by who asked
        if self._goes_on(text, m, closed):
            return False
        if mark != ".":
            return True
        follower = _type(word)
        begins = follower in self.starters or (letter.isupper() and follower in self.common)
        if closed and closed[0] in ")]":
            return bool(letter) and (not letter.isdigit() or True)
        if letter.isdigit() and (kind, "##") in self.collocations:
            return False
        if kind == "##" or (len(kind) == 1 and kind.isalpha()):
            if (kind, follower) in self.collocations and follower not in self.starters:
                return False
            if len(kind) == 1 and letter.isdigit():
                return False
            if kind == "##":
                return not (self.lang == "de" and letter.islower())
            if len(kind) == 1 and before.strip(_EDGE)[:1].isupper():
                return begins and not re.fullmatch(r"\w\.", word)
        if kind in self.abbreviations:
            if letter.isdigit() or not letter:
                return False
            return begins
        return True

    def starts(self, text: str) -> list[int]:
        """Where units begin, in code points."""
        letters = sum(map(str.isupper, text))
        lower_only = letters * 200 < len(text) and bool(re.search(r"[a-zà-öа-я]{3}", text)) and self.lang not in ("zh", "ja", "th", "hi", "ar", "he", "ko")
        cuts = [0]
        at = 0
        blocks = []
        for m in _BLANK.finditer(text):
            blocks.append((at, m.start()))
            at = m.end()
        blocks.append((at, len(text)))
        for lo, hi in blocks:
            if lo >= hi:
                continue
            cuts.append(lo)
            parts, skip = self._lines(text, lo, hi)
            cuts.extend(p for p, _ in parts[1:])
            for a, b in parts:
                part = text[a:b]
                ahead = skip.get(a, a) - a
                for m in _CANDIDATE.finditer(part):
                    if m.start() >= ahead and m.end() < len(part) and self.is_end(part, m, lower_only):
                        cuts.append(a + m.end())
        out = []
        for c in sorted(set(cuts)):
            while c < len(text) and text[c].isspace():
                c += 1
            if c < len(text) and (not out or c > out[-1]):
                out.append(c)
        return out

    @staticmethod
    def _lines(text: str, lo: int, hi: int) -> tuple[list[tuple[int, int]], dict[int, int]]:
        """A block cut at headings on lines of their own and at list entries; and where entries go
        on after their marks."""
        begins = [lo, *(m.end() for m in _LINE.finditer(text, lo, hi) if m.end() < hi)]
        cuts, skip = [lo], {}
        number = letter = 0
        dotted = False
        for i, b in enumerate(begins):
            e = begins[i + 1] if i + 1 < len(begins) else hi
            m = _MARK.match(text, b, e)
            entry = False
            if m:
                if m.group("num"):
                    entry = int(m.group("num")) == number + 1 and (i == 0 or number or e < hi)
                    number = int(m.group("num")) if entry else number
                elif m.group("let"):
                    place = ord(m.group("let").lower()) - 96
                    entry = place == letter + 1 and (letter > 0 or i == 0 or e < hi)
                    letter = place if entry else letter
                else:
                    entry = i == 0 or dotted or text[b:e].lstrip()[0] not in "-–—*"
                    dotted = dotted or entry
                    entry = True
            if entry:
                cuts.append(b)
                skip[b] = m.end()
                continue
            line = text[b:e].strip()
            heading = line.startswith("#") or (len(line) < 80 and sum(c.isalpha() for c in line) > 3 and line == line.upper() and line != line.lower() and line[-1:] not in ".!?,;:")
            if heading and len(begins) > 1:
                if not (line.startswith("#") is False and i and text[begins[i - 1] : b].strip().isupper() and b not in cuts):
                    follows = text[e:hi].split("\n", 1)[0]
                    if line.startswith("#") or not follows.isupper():
                        cuts.append(b)
                        if e < hi:
                            cuts.append(e)
        cuts = sorted(set(cuts))
        return list(zip(cuts, [*cuts[1:], hi])), skip


class Model:
    def __init__(self, rows: list[tuple[str, str, str, str | None]]):
        self.kinds: dict[tuple[str, str], set] = {}
        for lang, kind, word, follower in rows:
            self.kinds.setdefault((lang, kind), set()).add((word, follower) if kind == "collocation" else word)
        self.splitters: dict[str, Splitter] = {}

    def of(self, text: str) -> Splitter:
        lang = language(text, text.lower().split())
        if lang not in self.splitters:
            # a text of Latin script too short to tell its language uses what is known of all of them
            langs = [*_FUNCTION_WORDS, "latin"] if lang == "latin" else [lang]
            abbreviations, starters, collocations, common = (set().union(*(self.kinds.get((x, k), set()) for x in langs)) for k in ("abbreviation", "starter", "collocation", "common"))
            self.splitters[lang] = Splitter(lang, abbreviations, starters, collocations, common)
        return self.splitters[lang]


def split(texts: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``starts`` (ascending offsets of units in code points), a row for each different
    pair. Null, empty and blank texts give no rows; null ids are kept; very long texts are split
    whole; empty tables give no rows. Other columns are not read."""
    spark = texts.sparkSession
    entries = model.limit(MOST_ENTRIES + 1).count()
    if entries > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} learned entries; learn with a greater least")
    sent = spark.sparkContext.broadcast([tuple(r) for r in model.select("lang", "kind", "word", "follower").collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(sent.value)
        for batch in batches:
            found = [known.of(t).starts(t) if t and not t.isspace() else None for t in batch.column(1).to_pylist()]
            keep = pa.array([bool(f) for f in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["id", "starts"]).filter(keep)

    narrow = texts.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return narrow.mapInArrow(run, "id string, starts array<int>").distinct()


def sentence_units(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from ``texts`` and split them: ``id``, ``unit`` (from 0), ``start_char``; distinct rows.
    An id with several texts has the units of each."""
    units = split(texts, learn(texts, text_col), id_col, text_col)
    return units.select("id", F.posexplode("starts").alias("unit", "start_char"))
