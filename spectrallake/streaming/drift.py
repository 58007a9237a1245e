"""Drift of image stacks as frames arrive: one state a stack, the last frame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _shift(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    c = np.fft.ifft2(np.fft.fft2(a) * np.fft.fft2(b).conj()).real
    r, q = np.unravel_index(c.argmax(), c.shape)
    h, w = c.shape
    return int(r - h if r > h // 2 else r), int(q - w if q > w // 2 else q)


def streaming_drift(frames: DataFrame) -> DataFrame:
    """A stream of frames(stack, f, h, w, data) -> stack, f, dr, dc: the shift from each frame to the one before it in the stack.

    Frames of one stack arrive in order of f, within a batch in any order. The state is one frame a stack.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = np.frombuffer(state.get[0]).reshape(state.get[1], state.get[2]) if state.exists else None
        out = []
        rows = pd.concat(list(batches)).sort_values("f")
        for f, h, w, data in rows[["f", "h", "w", "data"]].itertuples(index=False):
            now = np.asarray(data, float).reshape(h, w)
            out.append((key[0], f, *(_shift(last, now) if last is not None else (0, 0))))
            last = now
        if last is not None:
            state.update((np.ascontiguousarray(last).tobytes(), last.shape[0], last.shape[1]))
        yield pd.DataFrame(out, columns=["stack", "f", "dr", "dc"])

    return frames.groupBy("stack").applyInPandasWithState(run, "stack long, f int, dr int, dc int", "last binary, h int, w int", "append", "NoTimeout")
