"""SimHash near-duplicates by covering locality-sensitive hashing.

Each bit position gets a random vector of r + 1 bits; table v (2^(r+1) - 1 of them, v not zero) keeps the
positions whose vector has an odd product with v.  Any r differing positions span less than r + 1
dimensions, so some v is orthogonal to all of them: that table drops every differing position and the pair
collides there, always.

Exact copies fold into one row per fingerprint before anything is compared.  Per bucket a task links the
fingerprints within the radius to a forest (never the pairs themselves).  A bucket above ``BUCKET`` is dealt
out again over the positions its table has dropped, by covering masks of those, level by level until none is larger,
so no task gets more and no link is lost.  Each level fixes about half of the positions still free, and n free
positions leave 2^n different fingerprints at most, so the levels end.  Where no more positions are free than the
radius allows, all of a bucket are linked to one, in one pass.  Links are contracted over the cluster, with checkpoints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import broadcast_if_small, fresh, per_batch
from tessera.operators.components import contract
from tessera.session import shuffle_width, stable_copy

RADIUS = 4
WORDS = 4  # words of a shingle
SEED = 42  # of XXH64
BUCKET = 4_096  # fingerprints compared pair by pair
SALTS = 16  # parts of a component's fingerprints in the join that names it
CHUNK = 200_000  # shingles hashed before they are folded into the bit counts


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64 bits, bit b set if it is set in over half of the shingles' hashes; no words: zero."""
    tokens = (text or "").encode().lower().split()  # bytes: only A-Z and the six ASCII white spaces count
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends.tolist()
    last = ends[words - 1 :] or [len(joined)]
    n, counts = len(last), np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + CHUNK], last[k : k + CHUNK], strict=False)], np.uint64)
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def _signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """``keep`` and the fingerprint as a signed long in ``out``; null and empty texts give zero."""
    return per_batch(df, text, [T.StructField(out, T.LongType())], lambda: lambda values: [[_signed(fingerprint(v)) for v in values]], keep)


def covering_masks(positions: list[int], radius: int, seed: int) -> list[int]:
    """Masks over ``positions`` such that any ``radius`` of them are all left out of some mask."""
    vectors = np.random.default_rng(seed).integers(0, 2 ** (radius + 1), 64)
    return [
        sum(1 << p for p in positions if bin(int(vectors[p]) & v).count("1") % 2)
        for v in range(1, 2 ** (radius + 1))
    ]


def _forest(fingerprints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of different fingerprints within ``radius`` of each other.

    Breadth first: each fingerprint is compared once with all that are not linked yet.
    """
    rest, a, b = fingerprints, [], []
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            at = front[:64]
            near = np.bitwise_count(at[:, None] ^ rest[None, :]) <= radius
            hit = near.any(axis=0)
            a.append(rest[hit])
            b.append(at[near[:, hit].argmax(axis=0)])
            front, rest = np.concatenate((front[64:], rest[hit])), rest[~hit]
    return (np.concatenate(a), np.concatenate(b)) if a else (fingerprints[:0], fingerprints[:0])


def links(fingerprints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``a, b`` (a > b, signed longs): links whose components are those of all pairs within ``radius``.

    ``fingerprints`` has one row per different fingerprint in column ``fp``.
    """
    width = shuffle_width(fingerprints.sparkSession)
    found, depth = None, 0
    level = fingerprints.select("fp", F.lit(0).cast("long").alias("compared")).repartition(width, "fp")
    while True:
        # a mask over all positions, joined to those compared before, is a covering mask of the positions still free
        masks = F.array(*[F.lit(_signed(m)) for m in covering_masks(list(range(64)), radius, seed=101 + depth)])
        rows = level.select("fp", "compared", F.explode(masks).alias("m")).select("fp", F.col("compared").bitwiseOR(F.col("m")).alias("compared"))
        if depth:
            rows = rows.distinct()  # different masks may fix the same positions
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("compared")))
        sizes = rows.groupBy("compared", "key").agg(F.count("*").alias("n"))
        free = 64 - F.bit_count("compared")
        large = stable_copy(sizes.where((F.col("n") > bucket) & (free > radius)).select("compared", "key"))
        none_large = large.isEmpty()
        small = rows if none_large else rows.join(broadcast_if_small(large), ["compared", "key"], "left_anti")
        buckets = small.groupBy("compared", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

        def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(0)
                values, cuts = lists.values.to_numpy().astype(np.int64), lists.offsets.to_numpy()
                size = np.diff(cuts)
                left, right = [], []
                for m in (2, 3):  # most buckets: all their pairs at once
                    first = cuts[:-1][size == m]
                    for i in range(m):
                        for j in range(i):
                            x, y = values[first + i], values[first + j]
                            near = np.bitwise_count((x ^ y).view(np.uint64)) <= radius
                            left.append(x[near])
                            right.append(y[near])
                for k in np.flatnonzero(size > 3):
                    x, y = _forest(values[cuts[k] : cuts[k + 1]].view(np.uint64), radius)
                    left.append(x.view(np.int64))
                    right.append(y.view(np.int64))
                x, y = np.concatenate(left), np.concatenate(right)
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["a", "b"])

        linked = buckets.mapInArrow(link, "a long, b long")
        found = linked if found is None else found.union(linked)
        if none_large:
            break
        level = stable_copy(rows.join(broadcast_if_small(large), ["compared", "key"], "left_semi").select("fp", "compared"))
        depth += 1
    return found.distinct()


def classes(fingerprinted: DataFrame, id_column: str, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``fp, root, component_id, members``: per different fingerprint its component (named by the fingerprint ``root``),
    the smallest id in it and its number of rows."""
    single = stable_copy(fingerprinted.groupBy("fp").agg(F.min(id_column).alias("least"), F.count("*").alias("n")))
    stars = contract(links(single, radius, bucket), []).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = single.join(stars, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    merged = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("members"), F.count("*").alias("prints"))
    merged = merged.where("prints > 1").drop("prints")
    # a component may hold a large part of all fingerprints, so its rows are dealt over several keys
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = broadcast_if_small(merged.select("*", salts.alias("salt")))
    return (
        rooted.withColumn("salt", F.pmod(F.hash("fp"), F.lit(SALTS)))
        .join(salted, ["root", "salt"], "left")
        .select("fp", "root", F.when(F.col("members").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("members", "n").alias("members"))
    )


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """Per row of ``df``: id, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest id reachable).

    Null and empty texts have fingerprint zero and link like any other.  Rows without an id take part; a
    component of such rows only has a null id.  Repeated rows stay.  Other columns of ``df`` are dropped.
    """
    rows = stable_copy(with_fingerprint(df.select(F.col(id_column).alias("id"), F.col(text).alias("text")), keep=["id"]))
    hexes = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(classes(rows, "id", radius), "fp", "left").select(F.col("id").alias(id_column), hexes.alias("fingerprint"), "component_id")


def drop_near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``df`` (all columns) that head their component: one row of each group stays, that of the smallest id.

    Rows of one component that share the smallest id (or have none) are cut to one of them.
    """
    fp, keeper, group, rank = fresh(df, "_fp", "_keeper", "_group", "_double")
    rows = stable_copy(with_fingerprint(df.select(F.col(id_column).alias("id"), F.col(text).alias("text")), keep=["id"]))
    groups = stable_copy(classes(rows, "id", radius).where("members > 1"))
    few = broadcast_if_small(groups.select(F.col("fp").alias(fp), F.col("component_id").alias(keeper), F.col("root").alias(group)))
    marked = with_fingerprint(df, text, fp).join(few, fp, "left")
    heads = marked.where(F.col(group).isNull() | F.col(id_column).eqNullSafe(F.col(keeper)))
    # heads that are not alone: several rows with the smallest id, perhaps under different fingerprints
    doubled = rows.join(groups, "fp").where(F.col("id").eqNullSafe(F.col("component_id")))
    doubled = stable_copy(doubled.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias(rank)))
    if doubled.isEmpty():
        return heads.select(*df.columns)
    same = F.col(id_column).eqNullSafe(F.col(rank))
    twice = heads.where(F.col(group).isNotNull()).join(broadcast_if_small(doubled), same, "left_semi")
    alone = heads.where(F.col(group).isNull()).unionByName(heads.where(F.col(group).isNotNull()).join(broadcast_if_small(doubled), same, "left_anti"))
    return alone.unionByName(twice.dropDuplicates([group])).select(*df.columns)


def op8(documents: DataFrame) -> DataFrame:
    """Per document: ``doc_id, fingerprint, component_id``."""
    return near_duplicates(documents)
