"""User-supplied steps: models over patches, extractors over tiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

Batches = Iterator[pd.DataFrame]


def score_patches(patches: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: StructType | str) -> DataFrame:
    """Run a user model over patch rows in Arrow batches.

    ``load()`` is called once per partition and returns the scoring function, so weights are read once
    per task, not per batch.
    """

    def run(batches: Batches) -> Batches:
        model = load()
        for batch in batches:
            yield model(batch)

    return patches.mapInPandas(run, schema)


def extract_instances(
    tile_px: DataFrame, extract: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str, tile: list[str]
) -> DataFrame:
    """One tile in, any number of instance rows out; a tile is bounded by the tile size."""
    return tile_px.groupBy(*tile).applyInPandas(extract, schema)
