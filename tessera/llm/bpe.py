"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Each task takes its documents in blocks, collects the distinct pre-tokens of a block and replays the merge
list over all of them at once.  An inverted index from token pair to the places where that pair stands is
built once; merges are taken in rank order, each visits only its own places (as arrays), and only the two
neighbours of a merged place are entered anew.  The cost follows the number of merges made, never words
times ranks, and a pre-token of megabytes is no worse than as many short ones.

Pairs are filed under the token they make (pairs that make the same token share its rank).  Should a merge
create a pair of lower rank than the one in hand, the order of merges inside that word matters; such words
are encoded once more on their own by the greedy rule.

The words replayed are kept in a bounded table per worker, so a frequent word is replayed once.  Nothing is
shuffled and nothing but the vocabulary file (fixed size) is broadcast; the words of one block bound memory.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256
from itertools import islice

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import per_batch
from tessera.llm.pretokens import Splitter

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BLOCK_CHARS = 1_500_000  # text of one replay
BLOCK_WORDS = 500_000  # pre-tokens of one replay when a single text is longer than that
KEPT_WORDS = 300_000  # words whose ids a worker remembers


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Codec:
    """Encoder and decoder for one rank file; texts in, packed little-endian uint32 ids out."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, kept_words: int = KEPT_WORDS, block_chars: int = BLOCK_CHARS):
        self.ranks = ranks
        self.tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.splitter = Splitter(pattern)
        self.kept_words, self.block_chars = kept_words, block_chars
        self.known: dict[str, bytes] = {}
        self.width = len(self.tokens) + 1
        pairs = sorted(
            (ranks[token[:k]] * self.width + ranks[token[k:]], rank)
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        )
        self.pairs = np.array([p[0] for p in pairs], np.int64)
        self.makes = np.array([p[1] for p in pairs], np.int64)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each two tokens make together, -1 if none; negative symbols are borders and holes."""
        if not len(self.pairs):
            return np.full(len(left), -1)
        pair = left * self.width + right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where((self.pairs[at] == pair) & (left >= 0) & (right >= 0), self.makes[at], -1)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of every word: all merges over all words, lowest rank first."""
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1)  # each word is followed by a border
        symbols = np.full(ends[-1] + 1, -1, np.int64)
        inner = np.ones(len(symbols), bool)
        inner[0] = False
        inner[ends] = False
        symbols[inner] = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        after = np.arange(1, len(symbols) + 1)
        before = np.arange(-1, len(symbols) - 1)
        places, queue = defaultdict(list), []

        def enter(at: np.ndarray, made: np.ndarray) -> None:
            at, made = at[made >= 0], made[made >= 0]
            if len(made) == 0:
                return
            order = np.argsort(made, kind="stable")
            at, made = at[order], made[order]
            cuts = np.flatnonzero(made[1:] != made[:-1]) + 1
            firsts = np.concatenate(([0], cuts)).tolist()
            for a, b, rank in zip(firsts, [*firsts[1:], len(at)], made[firsts].tolist(), strict=True):
                if rank not in places:
                    heapq.heappush(queue, rank)
                places[rank].append(at[a:b])

        enter(np.arange(len(symbols) - 1), self.joined(symbols[:-1], symbols[1:]))
        irregular = set()
        while queue:
            rank = heapq.heappop(queue)
            here = places.pop(rank)
            here = np.sort(np.concatenate(here)) if len(here) > 1 else here[0]
            here = here[symbols[here] >= 0]
            here = here[self.joined(symbols[here], symbols[after[here]]) == rank]
            if len(here) > 1:
                here = here[np.concatenate(([True], here[1:] != here[:-1]))]
                chained = after[here[:-1]] == here[1:]  # two places share a token: the left one goes first
                if chained.any():
                    k = np.arange(len(here))
                    start = np.maximum.accumulate(np.where(np.concatenate(([True], ~chained)), k, 0))
                    here = here[(k - start) % 2 == 0]
            if not len(here):
                continue
            gone = after[here]
            right = after[gone]
            if len(here) > 1:  # two places side by side: one at a time, the pair between them would stand for a while
                side = right[:-1] == here[1:]
                between = self.joined(np.full(side.sum(), rank), symbols[here[1:][side]])
                sooner = (between >= 0) & (between < rank)
                if sooner.any():
                    irregular.update(np.searchsorted(ends, here[:-1][side][sooner]).tolist())
            symbols[here], symbols[gone] = rank, -2
            after[here] = right
            before[right] = here
            left = before[here]
            made_left, made_right = self.joined(symbols[left], symbols[here]), self.joined(symbols[here], symbols[right])
            for made in (made_left, made_right):
                sooner = (made >= 0) & (made < rank)
                if sooner.any():
                    irregular.update(np.searchsorted(ends, here[sooner]).tolist())
            enter(np.concatenate((left, here)), np.concatenate((made_left, made_right)))
        counts = np.cumsum(symbols >= 0)
        packed = symbols[symbols >= 0].astype("<u4").tobytes()
        stops = (4 * counts[ends]).tolist()
        out = [packed[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]
        for k in irregular:
            out[k] = np.array(self.greedy(words[k]), "<u4").tobytes()
        return out

    def greedy(self, word: bytes) -> list[int]:
        """Lowest rank first, leftmost first, one merge at a time."""
        ids = [self.ranks[word[k : k + 1]] for k in range(len(word))]
        while len(ids) > 1:
            made = [self.ranks.get(self.tokens[a] + self.tokens[b], self.width) for a, b in zip(ids, ids[1:], strict=False)]
            k = min(range(len(made)), key=made.__getitem__)
            if made[k] == self.width:
                break
            ids[k : k + 2] = [made[k]]
        return ids

    def learn(self, words: Iterable[str]) -> None:
        """Enter the ids of words not seen lately."""
        todo = [w for w in words if w not in self.known]
        whole, rest = [], []
        for word in todo:
            raw = word.encode()
            (whole if raw in self.ranks else rest).append((word, raw))
        for word, raw in whole:  # a pre-token that is itself a token stays whole
            self.known[word] = self.ranks[raw].to_bytes(4, "little")
        for (word, _), ids in zip(rest, self.replay([raw for _, raw in rest]), strict=True):
            self.known[word] = ids

    def _forget(self) -> None:
        if len(self.known) > self.kept_words:
            self.known.clear()

    def _long(self, text: str) -> bytes:
        """One text of any length, a bounded number of pre-tokens at a time."""
        found, out = self.splitter.stream(text), []
        while words := list(islice(found, BLOCK_WORDS)):
            self.learn(set(words))
            out.append(b"".join(map(self.known.__getitem__, words)))
            self._forget()
        return b"".join(out)

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Packed ids of each text, in order; a null text is empty."""
        block, size = [], 0
        for text in texts:
            block.append(text or "")
            size += len(block[-1])
            if size >= self.block_chars:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)

    def _block(self, texts: list[str]) -> Iterator[bytes]:
        short = [None if len(t) > self.block_chars else self.splitter.split(t) for t in texts]
        self.learn(set().union(*[w for w in short if w is not None]))
        packed = [None if words is None else b"".join(map(self.known.__getitem__, words)) for words in short]
        self._forget()
        for text, ids in zip(texts, packed, strict=True):
            yield self._long(text) if ids is None else ids

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, unpacked(packed)))


def unpacked(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


_CODECS: dict[tuple, Codec] = {}  # one per worker process and vocabulary


def _codec(data: bytes, pattern: str) -> Codec:
    key = (sha256(data).digest(), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(parse_ranks(data), pattern)
    return _CODECS[key]


def _worker(df: DataFrame, path: str, pattern: str, work: Callable) -> Callable:
    """A task's function; the file is read here, so only Spark need reach the executors."""
    with open(path, "rb") as file:
        data = df.sparkSession.sparkContext.broadcast(file.read())

    def worker():
        codec = _codec(data.value, pattern)
        return lambda values: work(codec, values)

    return worker


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Every row of ``df`` with its token ids in ``ids`` (array of int); a null text has no tokens."""
    worker = _worker(df, path or public_tokenizers.path(VOCABULARY), pattern, lambda codec, values: [[unpacked(p) for p in codec.encode(values)]])
    return per_batch(df, text, [T.StructField(ids, T.ArrayType(T.IntegerType()))], worker)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Every row of ``df`` with the bytes of its ids in ``out``; null ids give empty bytes."""

    def work(codec, values):
        return [[b"".join(map(codec.tokens.__getitem__, v or ())) for v in values]]

    return per_batch(df, ids, [T.StructField(out, T.BinaryType())], _worker(df, path or public_tokenizers.path(VOCABULARY), pattern, work))


def round_trip(df: DataFrame, text: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, keep: list[str] | None = None) -> DataFrame:
    """Encode, then decode the ids again: ``keep``, packed ``ids``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    Null and empty texts have no tokens and the digests of nothing; repeated rows stay; the columns of ``df``
    outside ``keep`` are dropped, and those of ``keep`` may not bear the names made here.  The ids leave as
    little-endian unsigned 32-bit integers.
    """

    def work(codec, values):
        ids = list(codec.encode(values))
        return [
            ids,
            [len(p) // 4 for p in ids],
            [sha256(p).hexdigest() for p in ids],
            [sha256(codec.decode(p)).hexdigest() for p in ids],
        ]

    fields = [
        T.StructField("ids", T.BinaryType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
    return per_batch(df, text, fields, _worker(df, path or public_tokenizers.path(VOCABULARY), pattern, work), keep)


def op4(documents: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    return round_trip(documents, keep=["doc_id"]).drop("ids")
