"""Token counts by a map-side two-tier lookup.

First tier: a compact table of the lengths of frequent pre-tokens, fitted on a bounded sample of documents (``SAMPLE``
of at most ``SAMPLE_CHARS`` characters) and broadcast (at most ``FREQUENT`` short words, so its size has a bound).  It only
saves work and never changes a count: every other pre-token is a miss, encoded by the model of the library and kept in a
bounded cache of the worker.  Pre-tokens are never shuffled; every count covers the whole text of every document.

The library's own split decides what a pre-token is.  Where its Unicode tables are older than ours (some
letters and numbers), a text with such a character is counted by the library as a whole.  Special strings in
a text are cut out first, each one token, as the library does by default.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable
from functools import lru_cache
from hashlib import sha256

import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tessera.llm.common import per_batch
from tessera.llm.pretokens import Splitter

VOCABULARY = "byte_bpe_50k.json"
FREQUENT = 50_000  # pre-tokens in the frequent table
FREQUENT_CHARS = 32  # longest pre-token in it
SAMPLE = 2_000  # documents that the frequent table is fitted on
SAMPLE_CHARS = 10_000  # longest of them
KEPT_WORDS = 100_000  # misses that a worker remembers
CACHED_CHARS = 256  # longest of them
BLOCK_CHARS = 1_000_000  # longer texts are split word by word


@lru_cache(maxsize=4)
def foreign_characters(data: bytes) -> str:
    """Letters, numbers and spaces that the library's split takes for something else than ours does."""
    known = regex.compile(r"\p{L}|\p{N}|\s")
    chars = [c for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))) if known.match(c)]
    probe = "".join(f"a{c}1 " for c in chars)
    split = Tokenizer.from_buffer(data).pre_tokenizer
    theirs = {start for _, (start, _) in split.pre_tokenize_str(probe)}
    ours, at = set(), 0
    for word in Splitter().whole.findall(probe):
        ours.add(at)
        at += len(word)
    return "".join(sorted({chars[i // 4] for i in theirs ^ ours}))


def byte_alphabet() -> dict[int, str]:
    """For ``str.translate`` of bytes read as Latin-1: the characters that stand for bytes in byte-level vocabularies.

    Printable bytes stand for themselves, the others for the characters from 256 on, in order (fixed values).
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class Lengths(dict):
    """Token lengths of pre-tokens: the frequent ones, and a bounded cache of others, encoded when first asked for."""

    def __init__(self, frequent: dict[str, int], encoded: Callable[[str], int], kept_words: int):
        super().__init__(frequent)
        self.frequent, self.encoded, self.most = frequent, encoded, kept_words + len(frequent)

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
            self.update(self.frequent)
        length = self.encoded(word)
        if len(word) <= CACHED_CHARS:
            self[word] = length
        return length


class Counting:
    """Token counts of whole texts under one tokenizer file."""

    def __init__(self, data: bytes, frequent: dict[str, int], foreign: str, kept_words: int = KEPT_WORDS, block_chars: int = BLOCK_CHARS):
        self.tokenizer = Tokenizer.from_buffer(data)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = json.loads(data)["added_tokens"]
        self.special = [a["content"] for a in added]
        self.plain = not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added)
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if added else None
        self.foreign = frozenset(foreign)
        self.splitter = Splitter()
        self.alphabet, self.model = byte_alphabet(), self.tokenizer.model
        self.lengths = Lengths(frequent, self.encoded, kept_words)
        self.block_chars = block_chars

    def library(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encoded(self, word: str) -> int:
        """Length of one pre-token by the library's own model, without the offsets and masks of a full encoding."""
        return len(self.model.tokenize(word.encode().decode("latin-1").translate(self.alphabet)))

    def pieces(self, text: str) -> int:
        words = self.splitter.split(text) if len(text) <= self.block_chars else self.splitter.stream(text)
        return sum(map(self.lengths.__getitem__, words))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        marked = any(s in text for s in self.special)
        if (marked and not self.plain) or (not text.isascii() and not self.foreign.isdisjoint(text)):
            return self.library(text)
        parts = self.cut.split(text) if marked else [text]
        return len(parts) - 1 + sum(map(self.pieces, parts))


def frequent_lengths(df: DataFrame, text: str, data: bytes, most: int = FREQUENT, sample: int = SAMPLE) -> dict[str, int]:
    """Token lengths of the most frequent short pre-tokens of a bounded sample: the first documents that a scan gives."""
    short = df.where(F.length(text) <= SAMPLE_CHARS).select(F.col(text).alias("t")).limit(sample)
    counts, splitter = Counter(), Splitter()
    for row in short.collect():  # at most SAMPLE texts of SAMPLE_CHARS characters
        counts.update(w for w in splitter.split(row["t"]) if len(w) <= FREQUENT_CHARS)
    words = [w for w, n in counts.most_common(most) if n > 1]
    tokenizer = Tokenizer.from_buffer(data)
    return {w: len(e.ids) for w, e in zip(words, tokenizer.encode_batch(words, add_special_tokens=False), strict=True)}


_COUNTERS: dict[bytes, Counting] = {}  # one per worker process, vocabulary and frequent table


def with_token_counts(df: DataFrame, text: str = "text", path: str | None = None, limit: int = 512, keep: list[str] | None = None) -> DataFrame:
    """``keep`` and ``n_bytes``, ``n_tokens`` (long), ``over_limit`` (n_tokens > limit) for every row.

    Null and empty texts count nothing; repeated rows stay; columns of ``df`` outside ``keep`` are dropped, and
    those of ``keep`` that bear the names made here are replaced.
    """
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as file:
        data = file.read()
    foreign = foreign_characters(data)
    frequent = frequent_lengths(df, text, data)
    shared = df.sparkSession.sparkContext.broadcast((data, frequent, foreign))
    key = sha256(repr((sha256(data).hexdigest(), sorted(frequent.items()))).encode()).digest()

    def worker() -> Callable:
        if key not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[key] = Counting(*shared.value)
        counting = _COUNTERS[key]

        def work(values):
            tokens = [counting.count(v) for v in values]
            return [[len((v or "").encode()) for v in values], tokens, [n > limit for n in tokens]]

        return work

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return per_batch(df, text, fields, worker, keep)


def op6(documents: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_tokens, over_limit``."""
    return with_token_counts(documents, keep=["doc_id"])
