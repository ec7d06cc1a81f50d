"""Near-duplicate texts by the Jaccard similarity of their shingle sets, every link verified.

SimHash links (four bits of 64) miss most pairs of different texts at similarity 0.8, so they only propose.  What they
propose and what the exact set join below proposes is verified on the whole sets, and only verified links count.

* Texts of one word sequence fold into one number, its 64-bit hash (two of n different texts meet by chance at about
  n^2 / 2^65); texts are read again rather than kept, and whole sets are made only of those with a possible partner.
* Shingles have one global order, rare ones first: by a count over all texts in ``2 ** SKETCH`` cells of the hash space
  (a table of fixed size), then by hash.  Any total order is right; a good one keeps shared passages out of the prefixes.
* Prefix filter: similar sets share one of their first ``n - need + 1`` shingles.  Length filter and positional
  filter: at the first shingle they share, both must have enough shingles left.
* Only components are wanted, so a group of copies needs a tree, not all its pairs: rounds link every shared shingle's
  sets to the one that holds it earliest in its order (copies of one text meet that text), and the components so far drop out.
  Rounds go on while they pay; what is left, pairs of different components that share a prefix shingle, is compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import simhash
from tessera.llm.common import broadcast_if_small, fresh, per_batch
from tessera.operators.components import contract
from tessera.session import stable_copy

WORDS = 5  # words of a shingle
NEED = (4, 5)  # least similarity, as a fraction
SKETCH = 18  # bits of a shingle's hash that name its cell
CACHED_WORDS = 100_000  # hashes of words that a worker keeps, of at most CACHED_BYTES each
CACHED_BYTES = 64
FLUSH = 1_000_000  # shingles gathered before they are counted
BROADCAST_PAIRS = 300_000  # pairs of row numbers: some 20 MB at most
BROADCAST_SHINGLES = 2_000_000  # in the sets of the second side: 16 MB
QUARTER = -(1 << 62)  # signed hashes below it are a quarter of all
PAYS = 4  # candidate pairs a posting up to which all pairs are compared at once


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: only A-Z and the six ASCII white spaces count


def sequence_hash(text: str | None) -> int:
    """A signed long that names the word sequence of a text, case of A-Z folded."""
    return simhash._signed(xxhash.xxh3_64_intdigest(b" ".join(_words(text))))


class _WordHashes(dict):
    """XXH64 by word, for the short words a worker has seen lately."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = value
        return value


_WORD_HASHES = _WordHashes()
_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)  # odd


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted different hashes of the ``words``-word windows, case of A-Z folded; fewer words: the whole sequence; none: empty.

    A window's hash is a polynomial in the XXH64 of its words, then spread over all bits.
    """
    tokens = _words(text)
    if not tokens:
        return np.zeros(0, np.int64)
    single = np.fromiter(map(_WORD_HASHES.__getitem__, tokens), np.uint64, len(tokens))
    width = min(words, len(tokens))
    hashes = np.full(len(tokens) - width + 1, width, np.uint64)
    for k in range(width):
        hashes = hashes * _STEP + single[k : k + len(hashes)]
    for _ in range(2):
        hashes = (hashes ^ (hashes >> np.uint64(32))) * _SPREAD
    return np.unique((hashes ^ (hashes >> np.uint64(32))).view(np.int64))


def with_sequence(df: DataFrame, text: str, out: str, keep: list[str] | None = None) -> DataFrame:
    return per_batch(df, text, [T.StructField(out, T.LongType())], lambda: lambda values: [[sequence_hash(v) for v in values]], keep)


def _cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def cell_counts(texts: DataFrame, words: int, bits: int = SKETCH) -> np.ndarray:
    """Shingles of all texts (column ``text``) per cell of the hash space; ``2 ** bits`` numbers, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << bits, np.int64)
        held, waiting = [], 0
        for batch in batches:
            for value in batch.column(0):
                held.append(_cells(shingle_set(value.as_py(), words), bits))
                waiting += len(held[-1])
                if waiting >= FLUSH:
                    sums += np.bincount(np.concatenate(held), minlength=1 << bits)
                    held, waiting = [], 0
        if waiting:
            sums += np.bincount(np.concatenate(held), minlength=1 << bits)
        (some,) = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["cell", "n"])

    counts = texts.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # columns, not rows, through the driver
    out = np.zeros(1 << bits, np.int64)
    out[counts["cell"].to_numpy()] = counts["n"].to_numpy()
    return out


def postings(texts: DataFrame, words: int = WORDS, need: tuple[int, int] = NEED, bits: int = SKETCH) -> DataFrame:
    """``h, sid, n, at``: the prefix of the set of every text, ``at`` counts from 0 in the global order; copies repeat."""
    counts = texts.sparkSession.sparkContext.broadcast(cell_counts(texts, words, bits))
    up, down = need

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        for batch in batches:
            for value in batch.column(0):
                text = value.as_py()
                hashes = shingle_set(text, words)
                n = len(hashes)
                if n:
                    k = n + (-up * n) // down + 1
                    order = np.lexsort((hashes, often[_cells(hashes, bits)]))[:k]
                    sid = np.full(k, sequence_hash(text))
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[order]), pa.array(sid), pa.array(np.full(k, n)), pa.array(np.arange(k))], ["h", "sid", "n", "at"])

    return texts.select("text").mapInArrow(prefix, "h long, sid long, n long, at long")


def whole_sets(texts: DataFrame, sids: DataFrame, words: int) -> DataFrame:
    """``sid, n, some, shingles`` for the texts that ``sids`` names, one row each; ``some`` are the shingles of a quarter of the hash space."""
    named = with_sequence(texts, "text", "sid", ["text"]).join(broadcast_if_small(sids), "sid", "left_semi").dropDuplicates(["sid"])
    many = T.ArrayType(T.LongType(), False)
    fields = [T.StructField("n", T.LongType()), T.StructField("some", many), T.StructField("shingles", many)]

    def work(values):
        sets = [shingle_set(v, words) for v in values]
        return [[len(s) for s in sets], [s[: np.searchsorted(s, QUARTER)] for s in sets], sets]

    return per_batch(named, "text", fields, lambda: work, ["sid"])


def _enough(n, m, need: tuple[int, int]):
    """Least size of the intersection of similar sets of ``n`` and ``m``."""
    up, down = need
    return F.ceil(F.lit(up) * (n + m) / F.lit(up + down)).cast("long")


def _with_sets(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """``a, na, sa, b, nb, sb`` of the ``pairs`` (a, b), with ``column`` of ``sets`` on either side."""
    some = pairs.limit(BROADCAST_PAIRS + 1).count()
    few = F.broadcast(pairs) if some <= BROADCAST_PAIRS else pairs
    left = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col(column).alias("sa")).join(few, "a")
    heads = pairs.select("b").distinct()
    heads = F.broadcast(heads) if some <= BROADCAST_PAIRS else heads
    right = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col(column).alias("sb")).join(heads, "b", "left_semi")
    total = right.agg(F.sum(F.size("sb"))).first()[0] or 0
    return left.join(F.broadcast(right) if total <= BROADCAST_SHINGLES else right, "b")


def verified(pairs: DataFrame, sets: DataFrame, need: tuple[int, int] = NEED) -> DataFrame:
    """The ``pairs`` (a, b) of ``sets`` that are similar, with a > b.  ``b`` should be the side with fewer different sets.

    First by a quarter of the sets: what either side has besides bounds the intersection, which few chance pairs pass.
    """
    pairs = stable_copy(pairs.distinct())
    if pairs.isEmpty():
        return pairs
    common, least = F.size(F.array_intersect("sa", "sb")), _enough(F.col("na"), F.col("nb"), need)
    rest = F.least(F.col("na") - F.size("sa"), F.col("nb") - F.size("sb"))
    hopeful = stable_copy(_with_sets(pairs, sets, "some").where(common + rest >= least).select("a", "b"))
    similar = _with_sets(hopeful, sets, "shingles").where(common >= least)
    return stable_copy(similar.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))


def with_partners(rows: DataFrame, need: tuple[int, int] = NEED) -> DataFrame:
    """The different postings that may meet another text at their shingle, and some that may not.

    Of two similar sets the smaller holds the first shingle they share among the first that sets of its own size could
    share, and the next larger set at that shingle is within its reach; behind it stands the larger one, of bounded size.
    One exchange by shingle; groups are read as sorted rows and not held.
    """
    up, down = need
    by_size = Window.partitionBy("h").orderBy("n", "sid")
    early = F.when(F.col("n") - F.col("at") >= _enough(F.col("n"), F.col("n"), need), F.col("n"))
    ranked = rows.repartition("h").distinct().select(
        "*",
        F.lead("n").over(by_size).alias("_next"),
        F.last(early, ignorenulls=True).over(by_size.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
    )
    as_smaller = (F.col("n") - F.col("at") >= _enough(F.col("n"), F.col("_next"), need)) & (down * F.col("n") >= up * F.col("_next"))
    as_larger = down * F.col("_before") >= up * F.col("n")
    return ranked.where(as_smaller | as_larger).drop("_next", "_before")


def components(texts: DataFrame, prints: DataFrame, words: int = WORDS, need: tuple[int, int] = NEED) -> DataFrame:
    """``a, b`` for every text ``a`` that is not the smallest number ``b`` of its component.

    ``texts`` has the column ``text``, ``prints`` one row per different word sequence: ``sid, fp``.
    """
    up, down = need
    shared = stable_copy(with_partners(postings(texts, words, need), need))

    heads = simhash.classes(prints, "sid").where("members > 1").select("fp", F.col("component_id").alias("b"))
    proposed = stable_copy(prints.join(heads, "fp").where("sid <> b").select(F.col("sid").alias("a"), "b"))
    named = shared.select("sid").union(proposed.select("a")).union(proposed.select("b")).distinct()
    sets = stable_copy(whole_sets(texts, stable_copy(named), words))
    found = verified(proposed, sets, need)
    stars = contract(found, [])

    while True:
        grouped = shared.join(broadcast_if_small(stars.withColumnsRenamed({"a": "sid", "b": "root"})), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        crossing = grouped.groupBy("h", "root").agg(F.count("*").alias("c"), F.min(F.struct("at", "sid", "n", "root")).alias("head"))
        per_shingle = crossing.groupBy("h").agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("own"), F.min("head").alias("head"))
        open_ = stable_copy(per_shingle.where("all * all > own").select("h", "all", ((F.col("all") * F.col("all") - F.col("own")) / 2).alias("pairs"), "head"))
        work = open_.agg(F.sum("pairs").alias("pairs"), F.sum("all").alias("rows")).first()
        if not work["rows"]:
            return stars
        if work["pairs"] <= PAYS * work["rows"]:
            break
        # to the set that holds the shingle earliest, if that is not of the same component
        near = grouped.join(open_.select("h", "head"), "h").where(F.col("root") != F.col("head.root"))
        near = near.where((down * F.least("n", "head.n") >= up * F.greatest("n", "head.n")))
        new = verified(near.select(F.col("sid").alias("a"), F.col("head.sid").alias("b")), sets, need)
        before, found = found, stable_copy(found.union(new).distinct())
        if new.isEmpty() or before.count() == found.count():
            break
        stars = contract(found, [])

    left = grouped.join(open_.select("h"), "h")
    x, y = left.alias("x"), left.alias("y")
    met = x.join(y, "h").where(
        (F.col("x.sid") > F.col("y.sid"))
        & (F.col("x.root") != F.col("y.root"))
        & (F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= _enough(F.col("x.n"), F.col("y.n"), need))
    )
    rest = verified(met.select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")), sets, need)
    return contract(found.union(rest).distinct(), [])


def drop_near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = WORDS, need: tuple[int, int] = NEED) -> DataFrame:
    """The rows of ``df`` (all columns) but for near-duplicates: of each component the row with the smallest id stays.

    Rows without an id come after those with one; among equal ids any one row stays.  Null and empty texts have no
    words and are copies of each other; texts of fewer than ``words`` words are one shingle, so only their equals are linked.
    """
    sid, head, least = fresh(df, "_sid", "_head", "_least")
    texts = df.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    rows = stable_copy(simhash.with_fingerprint(with_sequence(texts, "text", "sid"), keep=["id", "sid"]))
    first = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "sid")).alias("first")
    classes = stable_copy(rows.groupBy("sid").agg(F.min("fp").alias("fp"), first, F.count("*").alias("rows")))
    stars = components(texts, classes.select("sid", "fp"), words, need)
    nodes = stars.select(F.col("a").alias("sid")).union(stars.select(F.col("b").alias("sid"))).distinct()
    several = classes.where("rows > 1").select("sid").union(nodes).distinct()
    rooted = classes.join(stars.withColumnsRenamed({"a": "sid", "b": "root"}), "sid", "left")
    heads = rooted.groupBy(F.coalesce("root", "sid").alias("root")).agg(F.min("first").alias("first"))
    heads = heads.select(F.col("first.sid").alias("sid"), F.col("first.id").alias("least"), F.lit(True).alias("head"))
    marks = stable_copy(several.join(heads, "sid", "left"))
    own = F.col(head) & F.col(id_column).eqNullSafe(F.col(least))
    few = broadcast_if_small(marks.select(F.col("sid").alias(sid), F.coalesce("head", F.lit(False)).alias(head), F.col("least").alias(least)))
    kept = with_sequence(df, text, sid).join(few, sid, "left").where(F.col(head).isNull() | own)
    # several rows of one word sequence with the smallest id: one of them stays
    same = rows.join(marks.where("head"), "sid").where(F.col("id").eqNullSafe(F.col("least")))
    if same.groupBy("sid").count().where("count > 1").isEmpty():
        return kept.select(*df.columns)
    return kept.where(F.col(head).isNull()).unionByName(kept.where(head).dropDuplicates([sid])).select(*df.columns)
