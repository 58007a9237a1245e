"""Chains of operators, and the streaming drift."""

import numpy as np
import pytest

from spectrallake.functions import signal
from spectrallake.operators import grid
from spectrallake.plans import pipelines
from spectrallake.streaming.drift import streaming_drift


def test_cleaning_with_all_components_changes_nothing(spark):
    x = np.random.default_rng(0).random((10, 10))
    long = spark.createDataFrame([(0, r, c, float(x[r, c])) for r in range(10) for c in range(10)], "img long, r int, c int, v double")
    out = {(r.r, r.c): r.v for r in pipelines.pca_cleaned(long, 10, 10, 5, 5, 25).collect()}
    assert len(out) == 100 and max(abs(out[k] - x[k]) for k in out) < 1e-6


def test_cleaning_with_fewer_components(spark):
    """Windows that overlap, half of the components: as with numpy, the last window's values holding."""
    rng = np.random.default_rng(4)
    x = rng.random((10, 10))
    long = spark.createDataFrame([(0, r, c, float(x[r, c])) for r in range(10) for c in range(10)], "img long, r int, c int, v double")
    starts = [0, 3, 5]
    windows = np.stack([x[r : r + 5, c : c + 5].ravel() for r in starts for c in starts])
    u, s, vh = np.linalg.svd(windows, full_matrices=False)
    s[len(s) // 2 :] = 0
    want, back = np.zeros((10, 10)), (u * s) @ vh
    for k, (r, c) in enumerate((r, c) for r in starts for c in starts):
        want[r : r + 5, c : c + 5] = back[k].reshape(5, 5)
    got = {(r.r, r.c): r.v for r in pipelines.pca_cleaned(long, 10, 10, 5, 3).collect()}
    assert len(got) == 100 and max(abs(got[r, c] - want[r, c]) for r, c in got) < 1e-6
    with pytest.raises(AssertionError):
        pipelines.pca_cleaned(long, 10, 10, 5, 3, options=grid.WindowOptions((5, 5), (3, 3), zoom=4, interpolation=2))


def test_ring_graph_of_a_lattice(spark):
    x = np.zeros((40, 40))
    x[4::8, 4::8] = 1
    rng = np.random.default_rng(1)
    x = signal.smoothed(x[None], 2.0)[0] + 1e-6 * rng.random((40, 40))
    blocks = spark.createDataFrame([(0, 40, 40, x.ravel().tolist())], "img long, h int, w int, data array<double>")
    assert pipelines.ring_graph(blocks, 40, 40, 3.0, 1.0).count() > 0


def test_streaming_drift(spark, tmp_path):
    x = np.zeros((16, 16))
    x[5, 6] = 1
    rows = [(1, f, 16, 16, np.roll(x, (f, -f), (0, 1)).ravel().tolist()) for f in range(4)]
    schema = "stack long, f int, h int, w int, data array<double>"
    for k in range(2):
        spark.createDataFrame(rows[2 * k : 2 * k + 2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming_drift(stream).writeStream.format("memory").queryName("drift").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.f, r.dr, r.dc) for r in spark.sql("select * from drift").collect())
    assert len(got) == 4 and sum(g[1:] == (-1, 1) for g in got) >= 2
