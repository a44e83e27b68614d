"""Encoding a corpus with a public byte-level BPE tokenizer by prefix-sharing trie traversal.

The distinct words of a batch are put into a trie (held as their sorted byte strings, so that a
depth-first traversal is a walk over the list in which each word starts at its longest common
prefix with the word before). Every trie node keeps one state: the last token of the encoding of
the prefix it stands for. In BPE the encoding of a prefix is the encoding of a shorter prefix plus
that last token, so a node's state follows from its ancestors' states alone and the encodings of
shared prefixes are computed once. The last token of a node is the one vocabulary entry that ends
there and stands unmerged beside the last token of the prefix before it.

Defined results: null and empty texts have the empty list. Strings that look like special tokens
are ordinary text. Every text is encoded whole. Rows map one to one; there is no shuffle, and the
vocabulary (a file of fixed size) is the only broadcast.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

# The word pattern of the public tokenizer byte_bpe_50k.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words kept between batches by one Python worker; beyond it the memory of words starts anew.
MEMO_WORDS = 400_000

_INF = 1 << 60


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins for bytes in a byte-level BPE vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieEncoder:
    """Encodes words; one instance per Python worker."""

    def __init__(self, spec: bytes):
        import regex

        model = json.loads(spec)["model"]
        letters = _byte_letters()
        vocab: dict[str, int] = model["vocab"]
        self.find = regex.compile(WORDS).findall
        self.rank: dict[int, int] = {}  # token -> when its merge happens; bytes at -1
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[int, int] = {}  # left * 2**20 + right -> when they merge
        bytes_of: dict[int, bytes] = {vocab[c]: bytes([b]) for c, b in letters.items()}
        base = set(bytes_of)
        self.rank = dict.fromkeys(bytes_of, -1)
        for when, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.merged[a << 20 | b] = when
            if whole not in self.rank:
                self.rank[whole], self.parts[whole] = when, (a, b)
                bytes_of[whole] = bytes_of[a] + bytes_of[b]
        self.sound = base | set()
        self.apart: dict[int, bool] = {}
        for token, (a, b) in self.parts.items():  # merge order: parts come before wholes
            if a in self.sound and b in self.sound and self._stands(a, b, self.rank[token]):
                self.sound.add(token)
        # every suffix of a token -> the token it is, or -1; a backward scan stops at the first miss
        self.suffix: dict[bytes, int] = {}
        for token in self.sound:
            s = bytes_of[token]
            for i in range(len(s)):
                self.suffix.setdefault(s[i:], -1)
        for token in self.sound:
            self.suffix[bytes_of[token]] = token
        self.length = {token: len(bytes_of[token]) for token in self.sound}
        self.memo: dict[str, list[int]] = {}

    def _spine(self, token: int, side: int) -> list[int]:
        """The tokens that lie at one edge while ``token`` is being built, last one first."""
        out = [token]
        while (p := self.parts.get(out[-1])) is not None:
            out.append(p[side])
        return out

    def _stands(self, a: int, b: int, until: int = _INF) -> bool:
        """Whether the edge between ``a`` and ``b`` survives all merges before ``until``."""
        left, right = self._spine(a, 1), self._spine(b, 0)
        i, j = len(left) - 1, len(right) - 1
        while True:
            next_a = self.rank[left[i - 1]] if i else until
            next_b = self.rank[right[j - 1]] if j else until
            when = self.merged.get(left[i] << 20 | right[j])
            if when is not None and (when < next_a and when <= next_b if i or j else when < until):
                return False
            if not i and not j:
                return True
            if i and (not j or next_a <= next_b):
                i -= 1
            else:
                j -= 1

    def _beside(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) > 4_000_000:
                self.apart.clear()
            known = self.apart[key] = self._stands(a, b)
        return known

    def learn(self, words: set[str]) -> None:
        """Depth-first traversal of the trie of ``words``; fills ``memo``."""
        suffix, length, beside = self.suffix, self.length, self._beside
        last = [-1]  # last[i]: the last token of the encoding of the current path's first i bytes
        before = b""
        for data, word in sorted((w.encode("utf-8"), w) for w in words):
            shared, most = 0, min(len(before), len(data))
            while shared < most and before[shared] == data[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(data) + 1):
                start = end - 1
                while start >= 0 and (token := suffix.get(data[start:end])) is not None:
                    if token >= 0 and (start == 0 or beside(last[start], token)):
                        last.append(token)
                        break
                    start -= 1
                else:
                    raise AssertionError("no token ends here")
            ids, at = [], len(data)
            while at:
                ids.append(last[at])
                at -= length[last[at]]
            ids.reverse()
            self.memo[word] = ids
            before = data

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        split = [self.find(t) if t else [] for t in texts]
        memo = self.memo
        if fresh := set(chain.from_iterable(split)).difference(memo):
            self.learn(fresh)
        return [list(chain.from_iterable(map(memo.__getitem__, words))) for words in split]


_encoders: dict[int, TrieEncoder] = {}


def encoder_of(spec: bytes) -> TrieEncoder:
    """The worker's encoder for a vocabulary file; built once and kept while the worker lives."""
    key = hash(spec)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = TrieEncoder(spec)
    return _encoders[key]


def read_spec(path: str = TOKENIZER) -> bytes:
    with open(path, "rb") as f:
        return f.read()


#: Characters encoded at once: bounds a worker's memory whatever the lengths of the texts.
SLICE_CHARS = 2_000_000


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > SLICE_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """One row per row of ``docs``: its id and ``ids``, the text's token ids.

    Null and empty texts give the empty list; repeated rows stay repeated; an empty table gives an
    empty table. Other columns are not read."""
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_spec(path))
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(spec.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _slices(texts):
                ids = pa.array(enc.encode(texts[a:b]), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], ["id", "ids"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def count_tokens(docs: DataFrame, id_cols: list[str], text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """``id_cols`` and ``n_tokens`` of each row; 0 for null and empty texts."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(spec.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            n = [len(ids) for a, b in _slices(texts) for ids in enc.encode(texts[a:b])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], [*batch.schema.names[:-1], "n_tokens"])

    narrow = docs.select(*[docs[c] for c in id_cols], docs[text_col].alias("__text"))
    schema = T.StructType([*[docs.schema[c] for c in id_cols], T.StructField("n_tokens", T.LongType())])
    return narrow.mapInArrow(run, schema)
