"""Evaluation texts that leaked into a corpus, found by pigeonhole edit matching.

A test item of n words may lose a third of its words and take some isolated ones up: its error
budget is E words. Split into E + 1 pieces, an item with at most E errors keeps at least one piece
whole, so exact hits of pieces (hashed runs of two or more words) propose every passage that can
qualify; passages whose text lacks a third of the item's words are dropped at once, and Myers'
bit-parallel distance over words verifies the others within E errors. The exact check that follows
counts the item's words kept in order: two thirds are needed.

Words are compared after NFKC, case folding, removal of marks, tags and invisible characters; digit
groups are closed, and two parts that make a word of the items only together are put together (broken
lines, scanned pages). A changed spelling inside a word counts as a changed word.

Scale: one pass over the corpus, no shuffle of texts. Test items (the stated query set) are sent to the
executors, up to ``PASS_CHARS`` of them in one pass; a larger set takes more passes. Within a pass a text is split into
words once and searched for blocks of items whose table of words has at most ``BLOCK_CELLS`` cells, so a worker's memory
is bounded. Texts are searched whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import words as W

KEPT = 2 / 3  # share of an item's words that a passage must keep, in order
ADDED = 1 / 8  # isolated added words, as a share of the item's words
PASS_CHARS = 20_000_000
BLOCK_CELLS = 25_000_000  # items x words of a block, 4 bytes each

_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,80}>")
_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]")
_GROUPS = re.compile(r"(?<=\d)[.,'’  ](?=\d)")
_ACCENT = re.compile("[̀-ͯ]")


def item_words(text: str | None) -> list[str]:
    """The words that are compared."""
    if not text:
        return []
    if not text.isascii():
        text = _ACCENT.sub("", unicodedata.normalize("NFKD", _INVISIBLE.sub("", text)))
    if "<" in text:
        text = _TAG.sub(" ", text)
    return W.words(_GROUPS.sub("", text))


def budget(n: int) -> int:
    return n - needed(n) + int(n * ADDED)


def needed(n: int) -> int:
    return max(1, int(np.ceil(n * KEPT - 1e-9)))


def pieces(n: int) -> list[tuple[int, int]]:
    """Where the E + 1 pieces of an item of n words begin and end; the lengths differ by one at most."""
    k = min(n, budget(n) + 1)
    cuts = [n * i // k for i in range(k + 1)]
    return list(zip(cuts, cuts[1:]))


def myers(masks: dict[int, int], n: int, text: list[int]) -> list[int]:
    """For each word of ``text`` the least number of errors of the item against a passage ending there."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    out = []
    for w in text:
        eq = masks.get(w, 0)
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(zero | plus))
        down = plus & zero
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (full & ~(zero | up))
        minus = up & zero
        out.append(score)
    return out


def kept_in_order(masks: dict[int, int], n: int, text: list[int]) -> int:
    """How many of the item's words the passage repeats in the item's order (bit-parallel)."""
    full = (1 << n) - 1
    v = full
    for w in text:
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


class Items:
    """A block of test items, prepared once per Python worker."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.ids, split = [], []
        for qid, text in rows:
            if w := item_words(text):
                self.ids.append(qid)
                split.append(w)
        self.vocab = {w: i + 1 for i, w in enumerate(dict.fromkeys(chain.from_iterable(split)))}
        self.items = [[self.vocab[w] for w in s] for s in split]
        self.masks = []
        self.need = np.array([needed(len(i)) for i in self.items])
        self.has = np.zeros((len(self.items), len(self.vocab) + 1), np.float32)
        by_length: dict[int, dict[int, list[int]]] = {}
        for k, item in enumerate(self.items):
            masks: dict[int, int] = {}
            for i, w in enumerate(item):
                masks[w] = masks.get(w, 0) | 1 << i
            self.masks.append(masks)
            for w, bits in masks.items():
                self.has[k, w] = bits.bit_count()
            for a, b in pieces(len(item)):
                by_length.setdefault(b - a, {}).setdefault(self._code(item[a:b]), []).append(k << 32 | a)
        self.tables = {}
        for length, table in by_length.items():
            codes = np.array(sorted(table), dtype=np.uint64)
            lists = [table[c] for c in sorted(table)]
            sizes = np.array([len(x) for x in lists])
            self.tables[length] = (codes, np.array(list(chain.from_iterable(lists)), dtype=np.int64), np.cumsum(sizes) - sizes, sizes)

    @staticmethod
    def _code(item: list[int]) -> int:
        h = 0
        for w in item:
            h = (h * 0x9E3779B97F4A7C15 + w) & 0xFFFFFFFFFFFFFFFF
        return h

    def _places(self, text: list[str]) -> list[int]:
        """The words of a text as numbers of the items' words, 0 for others; broken words are closed."""
        get = self.vocab.get
        out = [get(w, 0) for w in text]
        gone = False
        for i, (a, b) in enumerate(zip(text, text[1:])):
            if not (out[i] and out[i + 1]) and len(a) + len(b) > 4 and (whole := get(a + b)):
                out[i], out[i + 1], gone = whole, -1, True
        return [w for w in out if w >= 0] if gone else out

    def search(self, texts: list[list[str]]) -> Iterator[tuple[int, str]]:
        """(place of the text, item id) of every leak; texts are given by their words."""
        if not self.items:
            return
        split = [self._places(t) for t in texts]
        counts = np.array([len(s) for s in split])
        flat = np.array(list(chain.from_iterable(split)), dtype=np.uint64)
        if not len(flat):
            return
        owner = np.repeat(np.arange(len(split)), counts)
        present = np.zeros((len(split), len(self.vocab) + 1), np.float32)
        present[owner, flat.astype(np.int64)] = 1
        present[:, 0] = 0
        enough = present @ self.has.T >= self.need
        starts = np.cumsum(counts) - counts
        hits = []
        for length, (codes, members, first, sizes) in self.tables.items():
            if len(flat) < length:
                continue
            code = np.zeros(len(flat) - length + 1, np.uint64)
            with np.errstate(over="ignore"):
                for k in range(length):
                    code = code * np.uint64(0x9E3779B97F4A7C15) + flat[k : k + len(code)]
            place = np.searchsorted(codes, code)
            place[place == len(codes)] = 0
            at = np.nonzero((codes[place] == code) & (owner[: len(code)] == owner[length - 1 :]))[0]
            if not len(at):
                continue
            rows = place[at]
            n = sizes[rows]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            who = members[np.repeat(first[rows], n) + inside]
            at = np.repeat(at, n)
            item, offset = who >> 32, who & 0xFFFFFFFF
            good = enough[owner[at], item]
            hits.append(np.stack([owner[at], item, at - starts[owner[at]] - offset], axis=1)[good])
        if not hits:
            return
        todo: dict[tuple[int, int], list[int]] = {}
        for d, k, start in np.unique(np.concatenate(hits), axis=0).tolist():
            todo.setdefault((d, k), []).append(start)
        for (d, k), begins in todo.items():
            if self._verify(k, split[d], begins):
                yield d, self.ids[k]

    def _verify(self, k: int, text: list[int], begins: list[int]) -> bool:
        item, masks = self.items[k], self.masks[k]
        n, most = len(item), budget(len(item))
        i = 0
        while i < len(begins):  # passages that overlap are searched as one
            lo = hi = begins[i]
            while i < len(begins) and begins[i] <= hi + n:
                hi = begins[i]
                i += 1
            a, b = max(0, lo - most), hi + n + most
            part = text[a:b]
            for end, errors in enumerate(myers(masks, n, part)):
                if errors <= most and kept_in_order(masks, n, part[max(0, end + 1 - n - most) : end + 1]) >= self.need[k]:
                    return True
        return False


_SLICE = 256


def blocks_of(rows: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """Items in blocks whose table of items x words stays within ``BLOCK_CELLS`` (an item beyond is a block of its own)."""
    out, block, words = [], [], 0
    for row in rows:
        more = len(row[1]) // 2 + 1  # no text has more words
        if block and (len(block) + 1) * (words + more) > BLOCK_CELLS:
            out.append(block)
            block, words = [], 0
        block.append(row)
        words += more
    return [*out, block] if block else out



def find_leaks(corpus: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "qid", item_text: str = "question") -> DataFrame:
    """Distinct (``id``, ``item``): the corpus documents that hold a passage of a test item.

    An item entered under several ids counts for each of them. Null, empty and wordless items and
    texts match nothing; null ids are left out; repeated rows count once; empty tables give no
    rows. Other columns are not read."""
    spark = corpus.sparkSession
    questions = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").distinct()
    chars = questions.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    passes = max(1, -(-chars // PASS_CHARS))
    texts = corpus.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    out = None
    for number in range(passes):
        some = questions.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == number) if passes > 1 else questions
        sent = spark.sparkContext.broadcast(blocks_of(sorted((r.i, r.t) for r in some.collect())))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            blocks = [Items(rows) for rows in sent.value]
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1)
                for lo in range(0, batch.num_rows, _SLICE):
                    split = [item_words(t) for t in texts.slice(lo, _SLICE).to_pylist()]
                    found = [f for block in blocks for f in block.search(split)]
                    if found:
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array([lo + d for d, _ in found])), pa.array([q for _, q in found], pa.string())], ["id", "item"])

        part = texts.mapInArrow(run, "id string, item string")
        out = part if out is None else out.union(part)
    return out.distinct()
