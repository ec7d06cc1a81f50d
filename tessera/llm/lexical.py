"""Ranked lexical search over posting lists with range-maximum sparse tables.

Documents are profiled once against the items' terms (number of terms, and the items' terms in them with their
counts); document frequencies and lengths are summed from those profiles.  Every task then turns its profiles
into index blocks: one posting list per term, in document order, with the impact of each posting, and a sparse
table of range maxima over the lists.  An item is answered in a block best interval first: the maxima of its terms
in an interval of documents add up to a bound; the interval with the highest bound is split at the document
with the largest single impact, which is scored exactly, and intervals whose bound falls below the item's
K-th score are left out.  Bounds are exact, so the answer is that of a full scan.

Documents are never shuffled; a task hands on K rows per item, ranked in two rounds so that no item meets in one
task with the rows of all others.  Items are taken in chunks of bounded size, one pass over the documents each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ROWS, fresh
from tessera.session import stable_copy

K = 20
CHUNK_CHARS = 4_000_000  # characters of item texts whose terms a worker holds at a time
BLOCK_POSTINGS = 400_000  # of an index block; its sparse table takes 4 bytes x log2(longest list) each
BLOCK_DOCS = 65_536
WIDTH = 32, 1_024  # intervals split at a time, from the first round to later ones
SALTS = 64  # first-round groups of an item
PIECE = 1 << 20  # bytes of a text whose terms are listed at a time

# [0-9A-Za-z] and everything beyond ASCII belong to terms; only A-Z change to lower case
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_lists(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a whole text in order, a piece at a time."""
    folded, at = (text or b"").translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


# --- profiles ---


def profiles(documents: DataFrame, vocabulary: list[bytes], text: str, id_column: str) -> DataFrame:
    """``id, n, terms, tf`` of every document with a term: ``terms`` are places in the vocabulary, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: i + 1 for i, w in enumerate(vocabulary)}
        width = len(vocabulary) + 1
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                sizes, found = [], []
                for k, value in enumerate(batch.column(1).to_pylist()):
                    size = 0
                    for words in term_lists(value):
                        size += len(words)
                        found.append(k * width + np.fromiter(filter(None, map(place.get, words)), np.int64))
                    sizes.append(size)
                keys, tf = np.unique(np.concatenate([np.empty(0, np.int64), *found]), return_counts=True)
                ends = np.searchsorted(keys, np.arange(len(sizes) + 1) * width).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32))) for v in (keys % width - 1, tf)]
                out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], ["id", "n", "terms", "tf"])
                yield out.filter(pa.array(np.array(sizes) > 0))

    given = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    return given.mapInArrow(run, "id long, n long, terms array<int>, tf array<int>")


# --- one index block ---


class Block:
    """Posting lists of some documents with range maxima; documents take places that keep like ones together."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, norm: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray, weight: np.ndarray):
        owner = np.repeat(np.arange(len(ids)), sizes)
        # like documents next to each other: by their most frequent term, then by length
        firsts = np.cumsum(sizes) - sizes
        leading = np.maximum.reduceat(tf.astype(np.int64) * len(weight) + (len(weight) - 1 - terms), firsts) % len(weight)
        order = np.lexsort((norm, leading))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids, self.known, self.n_docs = ids[order], known[order], len(ids)
        impact = weight[terms] * ((1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 12 * norm[owner]))
        keys = terms.astype(np.int64) * self.n_docs + place[owner]
        keep = np.flatnonzero(impact > 0)
        keep = keep[np.argsort(keys[keep])]
        self.keys, self.impact = keys[keep], impact[keep]
        self.starts = np.searchsorted(self.keys, np.arange(len(weight) + 1) * self.n_docs)
        longest = int(np.diff(self.starts).max(initial=1))
        self.table = np.zeros((max(longest, 1).bit_length(), len(keep)), np.int32)
        self.table[0] = np.arange(len(keep))
        for level in range(1, len(self.table)):
            half = 1 << (level - 1)
            a, b = self.table[level - 1, : len(keep) - 2 * half + 1], self.table[level - 1, half : len(keep) - half + 1]
            self.table[level, : len(a)] = np.where(self.impact[b] > self.impact[a], b, a)
        self.log = np.frexp(np.arange(longest + 1))[1] - 1

    def bounds(self, lo: np.ndarray, hi: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per interval (its postings lo to hi of every term): summed maxima, and the posting of the largest."""
        size = hi - lo
        some = size > 0
        level = np.where(some, self.log[size], 0)
        a = self.table[level, np.where(some, lo, 0)]
        b = self.table[level, np.where(some, hi - (1 << level), 0)]
        best = np.where(self.impact[b] > self.impact[a], b, a)
        value = np.where(some, self.impact[best] * times, 0)
        return value.sum(axis=1), best[np.arange(len(best)), value.argmax(axis=1)]

    def search(self, terms: np.ndarray, times: np.ndarray, top: "Top") -> None:
        held = self.starts[terms + 1] > self.starts[terms]
        terms, times = terms[held], times[held]
        if not len(terms):
            return
        base = terms.astype(np.int64) * self.n_docs
        lo, hi = self.starts[terms][None, :], self.starts[terms + 1][None, :]
        bound, best = self.bounds(lo, hi, times)
        width = WIDTH[0]
        while len(bound):
            if len(bound) > width:
                first = np.argpartition(bound, len(bound) - width)
                rest, now = first[:-width], first[-width:]
                left = lo[rest], hi[rest], bound[rest], best[rest]
                lo, hi, best = lo[now], hi[now], best[now]
            else:
                left = None
            width = min(2 * width, WIDTH[1])
            doc = self.keys[best] % self.n_docs
            wanted = base[None, :] + doc[:, None]
            at = np.searchsorted(self.keys, wanted)
            there = self.keys[np.minimum(at, len(self.keys) - 1)] == wanted
            score = np.where(there, self.impact[np.minimum(at, len(self.keys) - 1)] * times, 0).sum(axis=1)
            top.offer(score, self.ids[doc], self.known[doc])
            lo, hi = np.concatenate([lo, at + there]), np.concatenate([at, hi])
            bound, best = self.bounds(lo, hi, times)
            if left is not None:
                lo, hi, bound, best = (np.concatenate(p) for p in zip((lo, hi, bound, best), left, strict=True))
            open_ = bound >= top.least
            lo, hi, bound, best = lo[open_], hi[open_], bound[open_], best[open_]


class Top:
    """The k best (score, id); equal scores by ascending id, null ids first."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.score, self.id, self.known = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def offer(self, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        good = score >= self.least
        if not good.any():
            return
        score, ids, known = (np.concatenate(p) for p in zip((self.score, self.id, self.known), (score[good], ids[good], known[good]), strict=True))
        order = np.lexsort((ids, known, -score))[: self.k]
        self.score, self.id, self.known = score[order], ids[order], known[order]
        if len(order) == self.k:
            self.least = int(self.score[-1])


def _blocks(batches: Iterator[pa.RecordBatch], weight: np.ndarray, n_docs: int, n_terms: int, most: int) -> Iterator[Block]:
    held, docs, postings = [], 0, 0

    def built() -> Block:
        return Block(*[np.concatenate(p) for p in zip(*held, strict=True)], weight)

    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            terms, tf = batch.column(2), batch.column(3)
            sizes = np.diff(terms.offsets.to_numpy())
            ids = batch.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            norm = np.array([75 + (25 * n * n_docs) // n_terms for n in batch.column(1).to_pylist()], np.int64)
            some = sizes > 0  # a document without any item's term has no score
            part = (ids.fill_null(0).to_numpy(zero_copy_only=False)[some], known[some], norm[some], sizes[some])
            held.append((*part, terms.flatten().to_numpy(), tf.flatten().to_numpy()))
            docs, postings = docs + int(some.sum()), postings + int(sizes.sum())
            if postings >= most or docs >= BLOCK_DOCS:
                yield built()
                held, docs, postings = [], 0, 0
    if docs:
        yield built()


def _answer(profiled: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], weight: np.ndarray, n_docs: int, n_terms: int, k: int, most: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = [Top(k) for _ in queries]
        for block in _blocks(batches, weight, n_docs, n_terms, most):
            for top, (_, terms, times) in zip(tops, queries, strict=True):
                block.search(terms, times, top)
        for start in range(0, len(queries), ROWS):
            some = [(rid, t) for (rid, _, _), t in zip(queries[start : start + ROWS], tops[start : start + ROWS], strict=True)]
            rid = np.repeat(np.array([r for r, _ in some], np.int64), [len(t.score) for _, t in some])
            ids, known, score = (np.concatenate([getattr(t, c) for _, t in some]) for c in ("id", "known", "score"))
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(ids, mask=~known), pa.array(score)], ["rid", "id", "score"])

    return profiled.mapInArrow(run, "rid long, id long, score long")


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_first("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _chunk(documents: DataFrame, items: list[tuple[int, bytes | None]], text: str, id_column: str, k: int, most: int) -> DataFrame:
    asked = {}
    for rid, value in items:
        counts: dict[bytes, int] = {}
        for words in term_lists(value):
            for w in words:
                counts[w] = counts.get(w, 0) + 1
        asked[rid] = counts
    vocabulary = sorted({w for counts in asked.values() for w in counts})
    profiled = stable_copy(profiles(documents, vocabulary, text, id_column))
    totals = profiled.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    held = profiled.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()  # one row a term
    weight = np.zeros(len(vocabulary) + 1, np.int64)
    for row in held:
        weight[row["term"]] = int(np.floor(1000 * np.log((2 * totals["docs"] + 2) / (2 * row["df"] + 1))))
    place = {w: i for i, w in enumerate(vocabulary)}
    queries = []
    for rid, counts in asked.items():
        terms = np.array([place[w] for w in counts], np.int64)
        queries.append((rid, terms, np.array(list(counts.values()), np.int64)))
    found = _answer(profiled, queries, weight, totals["docs"], totals["terms"], k, most)
    salted = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    return _ranked(_ranked(salted, ["rid", "salt"], k).drop("rank"), ["rid"], k).select("rid", "rank", "id", "score")


def search(
    documents: DataFrame,
    items: DataFrame,
    k: int = K,
    text: str = "text",
    id_column: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    chunk_chars: int = CHUNK_CHARS,
    block_postings: int = BLOCK_POSTINGS,
) -> DataFrame:
    """Each item's ``k`` documents of the highest score above 0: ``item_id, rank, doc_id, score``.

    Null and empty texts have no terms: such documents count for nothing, such items get no rows.  Every row is a
    document or an item of its own, so rows that share an id are ranked each; equal scores go by ascending id, null ids
    first.  ``id_column`` is a long.  Other columns are dropped.
    """
    (rid,) = fresh(items, "rid")
    numbered = stable_copy(items.select(F.col(item_id).alias("item"), F.col(item_text).cast("binary").alias("text"), F.monotonically_increasing_id().alias(rid)))
    chars = numbered.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 64)).first()[0] or 0
    chunks = -(-int(chars) // chunk_chars)
    out = None
    for c in range(chunks):
        mine = numbered.where(F.pmod(F.hash(rid), F.lit(chunks)) == c)
        asked = [(r[rid], r["text"] and bytes(r["text"])) for r in mine.select(rid, "text").collect()]  # a chunk's items only
        part = _chunk(documents, asked, text, id_column, k, block_postings).withColumnRenamed("rid", rid)
        named = part.join(mine.select(rid, "item"), rid).select(F.col("item").alias(item_id), "rank", F.col("id").alias(id_column), "score")
        out = named if out is None else out.unionByName(named)
    if out is None:
        blank = numbered.select(F.col("item").alias(item_id), F.lit(1).alias("rank"), F.lit(None).cast("long").alias(id_column), F.lit(1).cast("long").alias("score"))
        return blank.where("false")
    return out


def op11(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Each benchmark item's 20 best documents: ``item_id, rank, doc_id, score``."""
    return search(documents, benchmark)
