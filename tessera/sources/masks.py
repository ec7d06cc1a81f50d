"""Tissue masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from tessera.operators.rasters import resize_nearest


def load_mask(px: DataFrame, width: Column, height: Column) -> DataFrame:
    """Binarise (value > 0) and bring to the processing size by nearest resize.

    ``px(image_id, x, y, v, w, h)``; the result lists tissue pixels only.
    """
    return resize_nearest(px.where("v > 0"), width, height).drop("v")
