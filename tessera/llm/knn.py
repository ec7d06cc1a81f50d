"""Exact top-k search as a Voronoi kNN join.

A bounded sample of rows gives the pivots; every vector belongs to its nearest one.  Two summaries (a row per
pivot: counts, radii, norms, the k + 1 smallest distances) give each group of queries a score that k
candidates are sure to reach: for a query q of pivot a (radius r) and a candidate d of pivot p,

    q.d >= a.p - r |p| - |q| |d - p|        and        q.d <= a.d + r |d|.

Only candidates whose upper bound reaches the group's score are sent to it, packed by the block; a query group
is cut into parts of at most ``PART`` queries and its candidates into slices, so a hot pivot is many tasks.
Each task solves its part against its slice, and the slices' top k are merged.

Scores are integer inner products.  They are exact in float64 while they stay below 2^53 and are taken in
Python integers beyond (clipped to 64 bits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import stable_copy

SCALE = 1024
EVERY = 100  # rows whose id this divides are queries
K = 10
PIVOTS = 64  # sample size, whatever the input
PART = 1_024  # queries of one task
SLICE = 200_000  # candidates of one task
EXACT = float(2**53)


def _quantised(values: list) -> np.ndarray | None:
    """floor(SCALE * x) as float64 integers, None for a vector that takes no part."""
    if any(v is None for v in values):
        return None
    x = np.asarray(values, np.float64)
    return np.floor(SCALE * x) if np.isfinite(x).all() else None


def quantise(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, v`` (packed float64 integers) of the rows that take part.

    Rows without an id, null vectors and those with a null or non-finite component are left out.  Rows that
    share an id are candidates each, and queries each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for key, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = _quantised(values)
                if v is not None:
                    ids.append(key)
                    out.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["id", "v"])

    valid = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    return valid.mapInArrow(run, "id long, v binary")


def _narrow(m: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in the smallest type that holds them, for the way over the network."""
    most = np.abs(m).max(initial=0)
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
    return kind, m.astype(kind).tobytes()


def _matrix(packed: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows; a vector shorter than the longest is continued with zeros."""
    out = np.zeros((len(packed), width))
    for i, p in enumerate(packed):
        out[i, : len(p) // 8] = np.frombuffer(p)
    return out


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    bound = np.linalg.norm(queries, axis=1).max(initial=0) * np.linalg.norm(rows, axis=1).max(initial=0)
    if bound < EXACT / 4:
        return (queries @ rows.T).astype(np.int64)
    exact = np.frompyfunc(int, 1, 1)
    product = exact(queries) @ exact(rows).T
    return np.clip(product, -(2**63), 2**63 - 1).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, rids: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per query the places of its k best candidates but its own row: highest score, then smallest id."""
    for i in range(len(scores)):
        other = rids != own[i]
        row = np.flatnonzero(other)
        if len(row) > k:
            floor = np.partition(scores[i][row], len(row) - k)[len(row) - k]
            row = row[scores[i][row] >= floor]
        yield i, row[np.lexsort((ids[row], -scores[i][row]))][:k]


def top_k(
    df: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    every: int = EVERY,
    k: int = K,
    pivots: int = PIVOTS,
    part: int = PART,
    slice_rows: int = SLICE,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows of every row whose id ``every`` divides.

    Ties go to the smaller id; with fewer candidates all are returned.  A query leaves out its own row only: rows that share
    its id are found, and each of them asks for itself.  Other columns are dropped; an empty table gives no rows.  See ``quantise`` for the rows that take part.
    """
    vectors = stable_copy(quantise(df, id_column, vector))
    empty = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shape = vectors.agg(F.max(F.octet_length("v")).alias("bytes"), F.count("*").alias("n")).first()
    if not shape["n"]:
        return empty
    width, total = max(1, shape["bytes"] // 8), shape["n"]
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    centres = _matrix([bytes(row["v"]) for row in sample], width)
    shared = df.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        square = (c * c).sum(axis=1)
        for pdf in batches:
            m = _matrix(list(pdf["v"]), width)
            pivot = (square[None, :] - 2 * (m @ c.T)).argmin(axis=1)
            pdf["pivot"] = pivot.astype("int32")
            pdf["away"] = np.linalg.norm(m - c[pivot], axis=1)
            pdf["norm"] = np.linalg.norm(m, axis=1)
            yield pdf

    numbered = vectors.withColumn("rid", F.monotonically_increasing_id())
    placed = stable_copy(numbered.mapInPandas(assign, "id long, v binary, rid long, pivot int, away double, norm double"))
    is_query = F.col("id") % every == 0
    nearest = Window.partitionBy("pivot").orderBy("away", "id")
    near = placed.select("pivot", "away", "id").withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k + 1)
    candidates = {r["pivot"]: r["away"] for r in near.groupBy("pivot").agg(F.sort_array(F.collect_list("away")).alias("away")).collect()}
    groups = placed.where(is_query).groupBy("pivot").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.max("norm").alias("norm")).collect()
    if not groups:
        return empty

    # the k + 1 best guaranteed candidates: one of them may be the query itself
    names, floors, parts, radii = [], [], [], []
    for g in groups:
        a = centres[g["pivot"]]
        sure = sorted((a @ centres[p] - g["radius"] * np.linalg.norm(centres[p]) - g["norm"] * d for p, away in candidates.items() for d in away), reverse=True)
        floor = sure[k] if len(sure) > k else -np.inf
        names.append(g["pivot"])
        floors.append(floor - 1 - 1e-9 * abs(floor) if np.isfinite(floor) else floor)
        parts.append(-(-g["n"] // part))
        radii.append(g["radius"])
    slices = -(-total // slice_rows)
    plan = df.sparkSession.sparkContext.broadcast((np.array(names), np.array(floors), np.array(radii), np.array(parts)))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        which, floor, radius, cut = plan.value
        c = shared.value[which]
        for pdf in batches:
            m, ids, rids = _matrix(list(pdf["v"]), width), pdf["id"].to_numpy(), pdf["rid"].to_numpy()
            reach = c @ m.T
            reach = reach + radius[:, None] * pdf["norm"].to_numpy()[None, :] * (1 + 1e-9) + 1
            home = rids % slices
            for g in range(len(which)):
                for s in np.unique(home):
                    hit = (reach[g] >= floor[g]) & (home == s)
                    if hit.any():
                        kind, packed = _narrow(m[hit])
                        row = {"ids": ids[hit].astype("int64").tobytes(), "rids": rids[hit].astype("int64").tobytes(), "kind": kind, "vs": packed}
                        yield pd.DataFrame([{"pivot": which[g], "part": p, "slice": s} | row for p in range(cut[g])])

    def query_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        which, _, _, cut = plan.value
        cuts = dict(zip(which.tolist(), cut.tolist(), strict=True))
        for pdf in batches:
            pdf["part"] = [int(i) % cuts[p] for i, p in zip(pdf["rid"], pdf["pivot"], strict=True)]
            for s in range(slices):
                yield pdf[["pivot", "part", "id", "rid", "v"]].assign(slice=s)

    sent = placed.mapInPandas(send, "pivot int, part int, slice int, ids binary, rids binary, kind string, vs binary")
    asked = placed.where(is_query).select("pivot", "id", "rid", "v").mapInPandas(query_parts, "pivot int, part int, id long, rid long, v binary, slice int")

    def solve(questions: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        own, q = questions["rid"].to_numpy(), _matrix(list(questions["v"]), width)
        place, vec, score = [], [], []
        for block in blocks.itertuples(index=False):
            ids, rids = np.frombuffer(block.ids, np.int64), np.frombuffer(block.rids, np.int64)
            m = np.frombuffer(block.vs, block.kind).astype(np.float64).reshape(-1, width)
            scores = _scores(q, m) if len(q) and len(m) else np.zeros((0, 0), np.int64)
            for i, best in _best(scores, ids, rids, own, k):
                place.append(np.full(len(best), i))
                vec.append(ids[best])
                score.append(scores[i][best])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        at = cat(place)
        asked_by = {"query_id": questions["id"].to_numpy()[at], "rid": own[at]}
        out = pd.DataFrame(asked_by | {"vec_id": cat(vec), "score": cat(score)})
        return out.sort_values(["rid", "score", "vec_id"], ascending=[True, False, True]).groupby("rid").head(k)

    key = ["pivot", "part", "slice"]
    solved = asked.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(solve, "query_id long, rid long, vec_id long, score long")
    order = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
    ranked = solved.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op3(embeddings: DataFrame) -> DataFrame:
    """Per query its ten best: ``query_id, rank, vec_id, score``."""
    return top_k(embeddings)
