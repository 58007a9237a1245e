"""Apply numpy functions to batches of equally large images in block form, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def map_images(blocks: DataFrame, fn: Callable[[np.ndarray], np.ndarray], h: int, w: int) -> DataFrame:
    """blocks(img, h, w, data) of one size -> img, h, w, data with data = fn(stack of images) of size h x w.

    fn works on an array (n, rows, columns) and is called once for each size in a batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (rows, cols), part in pdf.groupby(["h", "w"], sort=False):
                out = fn(np.stack(part["data"].to_numpy()).reshape(len(part), rows, cols))
                yield pd.DataFrame({"img": part["img"], "h": h, "w": w, "data": list(out.reshape(len(part), -1))})

    return blocks.select("img", "h", "w", "data").mapInPandas(run, "img long, h int, w int, data array<double>")


#: Most pixels that `map_to_rows` gives to its function at once; a larger image comes alone.
PIXELS = 1 << 16


def map_to_rows(blocks: DataFrame, fn: Callable[[np.ndarray, np.ndarray], dict], schema: str) -> DataFrame:
    """Any columns from fn(ids, stack of images), called for at most PIXELS pixels at once: what it makes may be many times their size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (rows, cols), part in pdf.groupby(["h", "w"], sort=False):
                step = max(1, PIXELS // max(rows * cols, 1))
                for k in range(0, len(part), step):
                    some = part.iloc[k : k + step]
                    yield pd.DataFrame(fn(some["img"].to_numpy(), np.stack(some["data"].to_numpy()).reshape(len(some), rows, cols)))

    return blocks.select("img", "h", "w", "data").mapInPandas(run, schema)
