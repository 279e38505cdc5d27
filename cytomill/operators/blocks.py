"""User functions over blocks of pixels, and the several outputs of one labelled block table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomill.operators.volume import face_pairs
from cytomill.session import cut

Step = tuple[Callable[..., pd.DataFrame], dict]


def map_blocks(px: DataFrame, block: Sequence[str], steps: Sequence[Step], schema) -> DataFrame:
    """Applies user steps (function, keyword arguments) one after another to each block's pixels.

    A block is bounded by the block grid, so one task never holds more than one block at a time.
    Each function gets the block's rows and `crop`, the block key as a dict.
    """
    chain, keys = list(steps), list(block)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        crop = {k: pdf[k].iloc[0] for k in keys}
        for fn, kw in chain:
            pdf = fn(pdf, crop=crop, **kw)
        return pdf

    return px.groupBy(*keys).applyInPandas(run, schema)


def block_outputs(px: DataFrame, block: int, img: Sequence[str] = ("image_id",), id: str = "gid") -> dict[str, DataFrame]:
    """Faces, boxes and ids of labelled blocks, from one stored table."""
    px = cut(px)
    boxes = px.groupBy(id).agg(F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") + 1).alias("y1"), (F.max("x") + 1).alias("x1"))
    return {"faces": face_pairs(px, block, img, id), "boxes": boxes, "ids": px.select(id).distinct()}


