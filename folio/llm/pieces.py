"""Oversized items cut at natural boundaries by recursive bisection.

A span longer than the limit minus the overlap is cut at the strongest boundary of its middle part
(ties: the one nearest the midpoint; where that part has none, at the one nearest the midpoint anywhere) and both halves are treated alike; then every piece but the
first is prolonged backwards by up to the overlap, from a boundary where there is one. Boundaries,
strongest first: blank line, sentence end, line end, clause sign, space; where a span has none, the
cut falls between characters that belong to no common cluster. Only oversized items reach Python.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 900
OVERLAP = 150

_BOUNDARIES = [
    (5, re.compile(r"\n[^\S\n]*\n\s*|[ \f]\s*")),
    (4, re.compile(r"(?:[.!?…]+[)\]\"'”’»]*|[。！？।؟۔]+[”’」』）]*)(?:\s+|(?<=[。！？”」』）]))")),
    (3, re.compile(r"[\n \r]\s*")),
    (2, re.compile(r"[,;:—]\s+|[，、；：،؛]\s*")),
    (1, re.compile(r"\s+")),
]


def _joined(text: str, p: int) -> bool:
    """Whether the characters on both sides of ``p`` belong together."""
    c, before = text[p], text[p - 1]
    return (
        unicodedata.category(c) in ("Mn", "Mc", "Me")
        or c in "‍︎️"
        or before == "‍"
        or "\U0001f3fb" <= c <= "\U0001f3ff"
        or (before == "\r" and c == "\n")
    )


def cut_points(text: str, most: int) -> list[int]:
    """Where the spans of at most ``most`` characters begin, the first 0."""
    strength: dict[int, int] = {}
    for power, pattern in reversed(_BOUNDARIES):
        for m in pattern.finditer(text):
            if 0 < m.end() < len(text):
                strength[m.end()] = max(power, strength.get(m.end(), 0))
    places = sorted(strength)
    from bisect import bisect_left, bisect_right

    out, todo = [], [(0, len(text))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= most:
            out.append(lo)
            continue
        middle, third = (lo + hi) // 2, (hi - lo) // 3
        near = places[bisect_left(places, lo + max(1, third)) : bisect_right(places, hi - max(1, third))]
        if near:
            at = max(near, key=lambda p: (strength[p], -abs(p - middle), -p))
        elif outer := [p for p in places[max(0, bisect_left(places, middle) - 1) :][:2] if lo < p < hi]:
            at = min(outer, key=lambda p: (abs(p - middle), p))  # an unbroken run fills the middle part
        else:
            at = middle
            while at > lo + 1 and at > middle - 64 and _joined(text, at):
                at -= 1
        todo += [(at, hi), (lo, at)]
    return sorted(out)


def bisect_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, core start, end) of the pieces of ``text``: cores follow one another without a gap,
    pieces are at most ``limit`` long and begin up to ``overlap`` before their cores."""
    if len(text) <= limit:
        return [(0, 0, len(text))]
    cores = cut_points(text, limit - overlap)
    out = []
    for i, (a, b) in enumerate(zip(cores, [*cores[1:], len(text)])):
        start = a
        if i and overlap:
            least = max(cores[i - 1], a - overlap, b - limit)
            window = text[least:a]
            for _, pattern in _BOUNDARIES[:2] + _BOUNDARIES[4:]:
                found = next((m.end() for m in pattern.finditer(window) if m.end() < len(window)), None)
                if found is not None or (least == cores[i - 1] and window):
                    start = least if least == cores[i - 1] else least + found
                    break
            else:
                start = least
                while start < a and start > 0 and _joined(text, start):
                    start += 1
        out.append((start, a, b))
    return out


def items_of(papers: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id``, ``pos``, ``body``: every non-null section body; for papers with null or empty sections
    the text, at pos -1."""
    whole = F.array(F.struct(F.lit(-1).alias("pos"), F.col("text").alias("body")))
    parts = F.transform("sections", lambda s: F.struct(s["pos"].alias("pos"), s["body"].alias("body")))
    items = F.when(F.col("sections").isNull() | (F.size("sections") == 0), whole).otherwise(parts)
    return papers.select(F.col(id_col).cast("string").alias("id"), F.explode(items).alias("i")).select("id", "i.pos", "i.body").where("body is not null")


def split_oversized(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``items`` (id, pos, body) as ``id``, ``pos``, ``piece`` (from 0), ``pieces``, ``start``,
    ``core_start``, ``end`` (code points) and ``text``.

    Joining the cores restores the body. Items within the limit, empty ones included, are one piece;
    null bodies give no rows; repeated items give repeated rows; an empty table gives none."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                owner, rows = [], []
                for i, body in enumerate(part.column(2).to_pylist()):
                    cuts = bisect_text(body, limit, overlap)
                    for k, (start, core, end) in enumerate(cuts):
                        owner.append(i)
                        rows.append((k, len(cuts), start, core, end, body[start:end]))
                index = pa.array(owner, pa.int64())
                columns = [pa.array(c, pa.int32() if j < 5 else pa.string()) for j, c in enumerate(zip(*rows))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(index), part.column(1).take(index), *columns], ["id", "pos", "piece", "pieces", "start", "core_start", "end", "text"])

    length = F.length("body")
    some = items.select(F.col("id").cast("string").alias("id"), F.col("pos").cast("int").alias("pos"), "body").where("body is not null")
    short = some.where(length <= limit).select("id", "pos", F.lit(0).alias("piece"), F.lit(1).alias("pieces"), F.lit(0).alias("start"), F.lit(0).alias("core_start"), length.alias("end"), F.col("body").alias("text"))
    long = some.where(length > limit).mapInArrow(run, "id string, pos int, piece int, pieces int, start int, core_start int, end int, text string")
    return short.union(long)
