"""Square blocks of an image as units of work: rows sorted into blocks, read back portion by portion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 512


def block_of(value: Column, size: int = BLOCK) -> Column:
    """Number of the block that holds a coordinate (also for negative ones)."""
    return F.floor(value / F.lit(float(size))).cast("int")


def sorted_by_block(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of one key next to each other in one task; the key has to name a block, so that it is bounded."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def portions(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """(key, columns) for each stretch of rows with one key; a key goes on in the next portion if a batch ends within it."""
    for pdf in batches:
        columns = {c: pdf[c].to_numpy() for c in pdf.columns}
        if not len(pdf):
            continue
        fresh = np.zeros(len(pdf), bool)
        fresh[0] = True
        for k in keys:
            fresh[1:] |= columns[k][1:] != columns[k][:-1]
        ends = np.flatnonzero(fresh).tolist() + [len(pdf)]
        for lo, hi in zip(ends, ends[1:]):
            yield tuple(columns[k][lo] for k in keys), {c: v[lo:hi] for c, v in columns.items()}


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """(key, columns) for whole groups, for keys whose rows are bounded."""
    held_key, held = None, []
    for key, columns in portions(batches, keys):
        if held and key != held_key:
            yield held_key, {c: np.concatenate([h[c] for h in held]) for c in held[0]}
            held = []
        held_key = key
        held.append(columns)
    if held:
        yield held_key, {c: np.concatenate([h[c] for h in held]) for c in held[0]}


def many_groups(batches: Iterator[pd.DataFrame], keys: list[str], rows: int) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """(columns, first row of each group) for whole groups together, as soon as they have ``rows`` rows; rows of a key are bounded."""
    n = 0
    parts: list[dict[str, np.ndarray]] = []
    for pdf in batches:
        if len(pdf):
            parts.append({c: pdf[c].to_numpy() for c in pdf.columns})
            n += len(pdf)
        if n < rows:
            continue
        held, fresh = _joined(parts, keys)
        last = np.flatnonzero(fresh)[-1]  # the last group may go on
        if last:
            yield {c: v[:last] for c, v in held.items()}, np.flatnonzero(fresh[:last])
        parts, n = [{c: v[last:] for c, v in held.items()}], n - int(last)
    if n:
        held, fresh = _joined(parts, keys)
        yield held, np.flatnonzero(fresh)


def _joined(parts: list[dict[str, np.ndarray]], keys: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    held = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
    fresh = np.zeros(len(held[keys[0]]), bool)
    fresh[0] = True
    for k in keys:
        fresh[1:] |= held[k][1:] != held[k][:-1]
    return held, fresh
