"""Layers of convolutional networks on images in block form, and training with summed gradients.

Weights are small and go to every task; a batch of images is one numpy array. Training adds up the gradients of all
tasks by an aggregation and steps on the driver, so no image leaves its task. Whole networks are not kept here.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .iterate import forget, fresh_path
from .ranks import numbered, shuffled_batches

ACTIVATIONS = {
    None: lambda x: x,
    "relu": lambda x: np.maximum(x, 0),
    "lrelu": lambda x: np.where(x > 0, x, 0.01 * x),
    "tanh": np.tanh,
    "softplus": lambda x: np.logaddexp(0, x),
    "sigmoid": lambda x: 1 / (1 + np.exp(-x)),
}


def conv(x: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Same-size cross-correlation of x (n, channels, *space) with weight (out, channels, *kernel), odd kernels, 1 to 3 dimensions."""
    d = x.ndim - 2
    if d not in (1, 2, 3):
        raise AssertionError("1, 2 or 3 dimensions")
    pad = [(0, 0), (0, 0), *((k // 2, k // 2) for k in weight.shape[2:])]
    view = np.lib.stride_tricks.sliding_window_view(np.pad(x, pad), weight.shape[2:], axis=tuple(range(2, 2 + d)))
    axes = ([1, *range(2 + d, 2 + 2 * d)], list(range(1, 2 + d)))
    return np.moveaxis(np.tensordot(view, weight, axes), -1, 1) + bias.reshape(1, -1, *[1] * d)


def max_pool(x: np.ndarray) -> np.ndarray:
    for axis in range(2, x.ndim):
        n = x.shape[axis] // 2
        x = np.take(x, np.arange(2 * n), axis=axis)
        x = x.reshape(*x.shape[:axis], n, 2, *x.shape[axis + 1 :]).max(axis + 1)
    return x


def batch_norm(x: np.ndarray, p: dict) -> np.ndarray:
    shape = (1, -1, *[1] * (x.ndim - 2))
    return (x - p["mean"].reshape(shape)) / np.sqrt(p["var"].reshape(shape) + 1e-5) * p["gamma"].reshape(shape) + p["beta"].reshape(shape)


def upsample(x: np.ndarray, mode: str = "bilinear", factor: int = 2) -> np.ndarray:
    """Nearest or bilinear; bilinear in one or three dimensions falls back to nearest."""
    if mode not in ("nearest", "bilinear"):
        raise NotImplementedError(mode)
    for axis in range(2, x.ndim):
        n = x.shape[axis]
        if mode == "nearest" or x.ndim != 4:
            x = np.repeat(x, factor, axis)
            continue
        at = np.clip((np.arange(n * factor) + 0.5) / factor - 0.5, 0, n - 1)
        lo = np.floor(at).astype(int)
        hi, w = np.minimum(lo + 1, n - 1), at - lo
        shape = [1] * x.ndim
        shape[axis] = -1
        w = w.reshape(shape)
        x = np.take(x, lo, axis) * (1 - w) + np.take(x, hi, axis) * w
    return x


def formula_weights(shape: tuple[int, ...]) -> np.ndarray:
    """Weights without random numbers: ((5 i) mod 11 - 5) / (10 sqrt(fan-in)) over the flat index i."""
    i = np.arange(int(np.prod(shape)))
    return (((i * 5) % 11 - 5) / 10 / np.sqrt(max(np.prod(shape[1:]), 1))).reshape(shape)


class ConvBlock:
    def __init__(self, ndim: int, layers: int, inputs: int, outputs: int, *, batchnorm: bool = False, activation: str | None = "lrelu", pool: bool = False, kernel: int = 3):
        if ndim not in (1, 2, 3):
            raise AssertionError("ndim is 1, 2 or 3")
        if activation not in ACTIVATIONS:
            raise NotImplementedError(activation)
        self.activation, self.pool = ACTIVATIONS[activation], pool
        self.layers = []
        for k in range(layers):
            norm = {"mean": np.zeros(outputs), "var": np.ones(outputs), "gamma": np.ones(outputs), "beta": np.zeros(outputs)} if batchnorm else None
            self.layers.append({"weight": formula_weights((outputs, inputs if k == 0 else outputs, *[kernel] * ndim)), "bias": np.zeros(outputs), "norm": norm})

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for p in self.layers:
            x = self.activation(conv(x, p["weight"], p["bias"]))
            x = batch_norm(x, p["norm"]) if p["norm"] else x
        return max_pool(x) if self.pool else x


class UpsampleBlock:
    def __init__(self, ndim: int, inputs: int, outputs: int, mode: str = "bilinear"):
        if mode not in ("nearest", "bilinear"):
            raise NotImplementedError(mode)
        self.mode, self.weight, self.bias = mode, formula_weights((outputs, inputs, *[1] * ndim)), np.zeros(outputs)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return conv(upsample(x, self.mode), self.weight, self.bias)


def decode_grid(spark: SparkSession, d: int = 12, low: float = -1.65, high: float = 1.65) -> DataFrame:
    """i, j, z0, z1: d * d points of the latent plane; z0 descends along i, z1 ascends along j."""
    step = (high - low) / max(d - 1, 1)
    i, j = F.floor(F.col("id") / d).cast("int"), (F.col("id") % d).cast("int")
    return spark.range(d * d).select(i.alias("i"), j.alias("j"), (F.lit(high) - i * step).alias("z0"), (F.lit(low) + j * step).alias("z1"))


def batch_ids(df: DataFrame, key: str, size: int) -> DataFrame:
    """key, batch: rows in order of key, size at a time."""
    return numbered(df.select(key), [key]).select(key, F.floor(F.col("place") / size).cast("int").alias("batch"))


class Trainer:
    """A linear autoencoder (p -> k -> p) with the mean squared error, trained by Adam on gradients summed over all rows."""

    def __init__(self, p: int, k: int = 2, rate: float = 1e-3, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.weights = [rng.normal(0, 1 / np.sqrt(p), (p, k)), rng.normal(0, 1 / np.sqrt(k), (k, p))]
        self.rate, self.turn, self.losses = rate, 0, []
        self.m, self.v = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]

    def step(self, rows: DataFrame) -> float:
        from .factor import _summed

        a, b = self.weights
        p, k = a.shape

        def gradient(x):
            z = x @ a
            e = z @ b - x
            return np.concatenate([[len(x), (e**2).sum()], (x.T @ (e @ b.T)).ravel(), (z.T @ e).ravel()])

        s = _summed(rows, gradient, 2 + 2 * p * k)
        scale = 2 / (s[0] * p)
        self.turn += 1
        for n, g in enumerate((s[2 : 2 + p * k].reshape(p, k) * scale, s[2 + p * k :].reshape(k, p) * scale)):
            self.m[n] = 0.9 * self.m[n] + 0.1 * g
            self.v[n] = 0.999 * self.v[n] + 0.001 * g * g
            self.weights[n] = self.weights[n] - self.rate * (self.m[n] / (1 - 0.9**self.turn)) / (np.sqrt(self.v[n] / (1 - 0.999**self.turn)) + 1e-8)
        self.losses.append(float(s[1] / (s[0] * p)))
        return self.losses[-1]

    def loss(self, rows: DataFrame) -> float:
        """Mean squared error of rows as the weights are: a test pass, no step."""
        from .factor import _summed

        a, b = self.weights
        s = _summed(rows, lambda x: np.array([len(x), ((x @ a @ b - x) ** 2).sum()]), 2)
        return float(s[1] / max(s[0] * a.shape[0], 1))

    def fit(self, rows: DataFrame, epochs: int = 20, batch_size: int | None = None, test: DataFrame | None = None, seed: int = 1) -> list[float]:
        """Mean losses by epoch; with test rows, `test_losses` by epoch as well.

        Without batch_size an epoch is one step over all rows. With it rows are dealt to shuffled batches, anew each
        epoch, and a step reads its own batch only.
        """
        self.test_losses: list[float] = []
        done = []
        places = numbered(rows.select("id", "data"), ["id"]) if batch_size else None
        n = places.count() if batch_size else 0
        for epoch in range(epochs):
            if batch_size:
                done.append(self._epoch(shuffled_batches(places, n, batch_size, seed, epoch), -(-n // batch_size)))
            else:
                done.append(self.step(rows))
            if test is not None:
                self.test_losses.append(self.loss(test))
        return done

    def _epoch(self, dealt: DataFrame, batches: int) -> float:
        path = fresh_path(dealt.sparkSession, "batches")
        dealt.select("id", "data", "batch").repartition("batch").write.partitionBy("batch").parquet(path)
        stored = dealt.sparkSession.read.parquet(path)
        losses = [self.step(stored.where(F.col("batch") == k)) for k in range(batches)]
        forget(stored)
        return float(np.mean(losses))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(n, i, float(w)) for n, m in enumerate(self.weights) for i, w in enumerate(m.ravel())], "layer int, idx int, w double").write.mode("overwrite").parquet(path)
