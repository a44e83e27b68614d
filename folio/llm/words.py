"""Words of texts in any script, and their hashes, for operators on word shingles."""

from __future__ import annotations

import re
import unicodedata
from itertools import chain

import numpy as np
import xxhash

# Scripts written without spaces: each of their characters counts as a word.
_DENSE = "฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿"
_TOKEN = re.compile(rf"[{_DENSE}]|[^\W_{_DENSE}]+")

_FINE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]")  # letters: several make a word
_COARSE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")  # about two make a word


def letters_per_word(split: list[str]) -> int:
    """1 for texts of spaced words; where most words are single letters of a script without spaces,
    how many of them count as one."""
    single = "".join(w for w in split if len(w) == 1)
    if len(single) * 2 <= len(split):
        return 1
    fine, coarse = len(_FINE.findall(single)), len(_COARSE.findall(single))
    if 2 * (fine + coarse) <= len(split):
        return 1
    return 4 if fine > coarse else 2


_MEMO_LIMIT = 1_000_000
_memo: dict[str, int] = {}


def words(text: str | None) -> list[str]:
    """Case-folded words without layout: punctuation, markup signs and white space are dropped."""
    if not text:
        return []
    return _TOKEN.findall(unicodedata.normalize("NFKC", text).casefold())


def word_hashes(split: list[list[str]]) -> np.ndarray:
    """64-bit hashes of the words of all texts, one after the other."""
    if len(_memo) > _MEMO_LIMIT:
        _memo.clear()
    for w in set(chain.from_iterable(split)).difference(_memo):
        _memo[w] = xxhash.xxh3_64_intdigest(w)
    return np.array(list(map(_memo.__getitem__, chain.from_iterable(split))), dtype=np.uint64)


def shingle_hashes(hashes: np.ndarray, counts: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``widths`` words (a number for each text) and where each text's runs
    begin; texts of fewer words (but at least one) have one run of all their words. ``counts`` are
    the texts' word numbers, none 0."""
    n = len(hashes)
    ends = np.cumsum(counts)
    owner_end = np.repeat(ends, counts)
    at = np.arange(n)
    out = np.zeros(n, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)  # fixed value: odd multiplier
    with np.errstate(over="ignore"):
        wide = np.repeat(widths, counts)
        for k in range(int(widths.max())):
            inside = (at + k < owner_end) & (k < wide)
            take = np.minimum(at + k, n - 1)
            out = np.where(inside, out * factor + hashes[take], out)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)  # fixed value: odd multiplier
        out ^= out >> np.uint64(32)
    runs = np.maximum(counts - widths + 1, 1)
    starts = ends - counts
    keep = at - np.repeat(starts, counts) < np.repeat(runs, counts)
    return out[keep], np.cumsum(runs) - runs
