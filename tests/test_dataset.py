"""Headers that travel: units, axes and provenance through chains of operators, and to disk and back."""

import numpy as np
import pytest

from spectrallake.functions import signal
from spectrallake.operators import filters, grid, spectral
from spectrallake.sources import carriers, dataset
from spectrallake.sources.dataset import Axis


def bumps(dr=0, dc=0):
    r, c = np.meshgrid(np.arange(32) - dr, np.arange(40) - dc, indexing="ij")
    return sum(a * np.exp(-((r - y) ** 2 + (c - x) ** 2) / 8) for a, y, x in ((1, 10, 12), (0.8, 20, 25), (0.6, 14, 30)))


AXES = (Axis("x", 32, "nm", start=5.0, step=0.5), Axis("y", 40, "nm", start=-10.0, step=0.5))


def values(ds):
    return [np.array(r["data"]).reshape(ds.shape) for r in ds.data.orderBy("img").collect()]


def test_a_chain_keeps_units_and_provenance(spark, tmp_path):
    images = [bumps(), bumps(2, 1)]
    ds = dataset.from_array(spark, images, "probe", units="nA", quantity="current", axes=AXES)
    cut = dataset.crop(ds, (7.0, 19.0), (-8.0, 8.0))
    assert cut.shape == (24, 32) and [(a.start, a.step, a.units) for a in cut.header.axes] == [(7.0, 0.5, "nm"), (-8.0, 0.5, "nm")]
    assert all(np.array_equal(a, b[4:28, 4:36]) for a, b in zip(values(cut), images, strict=True))
    soft = dataset.smooth(cut, 1.0)
    assert np.allclose(values(soft), signal.smoothed(np.array(values(cut)), 2.0))
    power = dataset.power_spectrum(soft)
    u, v = power.header.axes
    assert (u.units, u.kind, u.size) == ("1/nm", "reciprocal", 24) and np.isclose(u.step, 1 / 12) and np.isclose(v.start, -16 / 16)
    assert np.allclose(values(power)[0], np.array(spectral.power_spectrum(soft.data, 24, 32).orderBy("img").first()["data"]).reshape(24, 32))
    assert [s["method"] for s in power.header.metadata["analysis"]] == ["crop", "smooth", "power_spectrum"]
    assert power.header.metadata["analysis"][1]["sigma"] == 1.0 and power.header.source == soft.header.title and soft.header.units == "nA"
    dataset.save(power, str(tmp_path / "power"))
    back = dataset.load(spark, str(tmp_path / "power"))
    assert back.header == power.header and np.array_equal(values(back), values(power))


def test_atoms_in_units(spark):
    ds = dataset.from_array(spark, [bumps()], axes=AXES)
    points, header = dataset.atoms(ds, 1.5)
    tiled, _ = dataset.atoms(ds, 1.5, tile=9)
    found = sorted((r.x, r.y, r.sigma) for r in points.collect())
    assert found == sorted((r.x, r.y, r.sigma) for r in tiled.collect())
    plain = filters.find_atoms(ds.data, 3.0)
    assert found == sorted((r.x * 0.5 + 5, r.y * 0.5 - 10, r.sigma * 0.5) for r in plain.collect())
    assert any(abs(x - 10) < 0.6 and abs(y + 4) < 0.6 for x, y, _ in found)
    assert header.data_type == "POINT_CLOUD" and header.metadata["analysis"][-1] == {"method": "find_atoms", "atom_size": 1.5, "threshold": -1.0}


def test_registration_in_units(spark):
    stack = dataset.from_array(spark, [bumps(), bumps(2, 1), bumps(3, -1)], axes=AXES)
    moved, drift = dataset.registered(stack)
    assert {r.f: (r.x, r.y) for r in drift.collect()} == {0: (1.0, 0.5), 1: (0.0, 0.0), 2: (-0.5, 1.0)}
    a, b, c = values(moved)
    assert np.abs(a - b).max() < 0.01 and np.abs(c - b).max() < 0.01
    rows, cols = moved.header.axes
    assert (rows.start, rows.size, cols.start, cols.size) == (6.0, 29, -9.0, 38)
    assert moved.header.metadata["analysis"][-1]["input_crop"] == [2, 31, 2, 40]
    with pytest.raises(TypeError):
        dataset.registered(dataset.from_array(spark, [bumps()]))


def test_factors_say_how_they_were_made(spark):
    ds = dataset.from_array(spark, [bumps(k % 3, k % 2) for k in range(8)], axes=AXES)
    weights, components, header = dataset.factorised(ds, "nmf", 2, rounds=3)
    assert weights.count() == 8 and components.shape == (2, 32 * 40)
    assert header.metadata["analysis"] == [{"method": "nmf", "components": 2, "rounds": 3}]


def test_what_is_refused(spark):
    with pytest.raises(TypeError):
        dataset.from_array(spark, [np.zeros((3, 3), complex)])
    with pytest.raises(ValueError):
        dataset.from_array(spark, [np.zeros(3)])
    with pytest.raises(ValueError):
        dataset.from_array(spark, [np.zeros((3, 3)), np.zeros((3, 4))])
    with pytest.raises(ValueError):
        dataset.from_array(spark, [np.zeros((3, 3))], axes=AXES)
    with pytest.raises(ValueError):
        dataset.Header("x", AXES, data_type="other")
    ds = dataset.from_array(spark, [bumps()], axes=(AXES[0], Axis("y", 40, "nm", step=0.25)))
    with pytest.raises(ValueError):
        dataset.smooth(ds, 1.0)
    with pytest.raises(ValueError):
        dataset.crop(ds, (6.0, 6.1), (0.0, 5.0))


def test_decon_and_spots_in_units(spark):
    square = dataset.from_array(spark, [bumps()[:, :32]], axes=(Axis("x", 32, "nm", step=0.5), Axis("y", 32, "nm", step=0.5)))
    sharp = dataset.decon(square, 1.0)
    assert np.allclose(values(sharp)[0].ravel(), filters.decon_lr(square.data, 32, 32, 2.0).first()["data"])
    found = dataset.spots(square, 0.3).collect()
    plain = spectral.diffractogram_spots(square.data, 0.3).collect()
    assert sorted((r.u, r.v) for r in found) == sorted((r.u / 0.5, r.v / 0.5) for r in plain)
    assert grid.crop_image(carriers.to_long(square.data), (0, 0, 2, 2)).count() == 4


def test_folds_of_any_axes(spark):
    x = np.arange(2 * 3 * 4 * 5.0).reshape(2, 3, 4, 5)
    long = spark.createDataFrame([(*k, float(v)) for k, v in np.ndenumerate(x)], "i int, j int, a int, b int, v double")
    sizes = {"i": 2, "j": 3, "a": 4, "b": 5}
    flat = {(r.row, r.col): r.v for r in grid.fold(long, ["i", "j"], ["a", "b"], sizes).collect()}
    assert flat == {k: v for k, v in np.ndenumerate(x.reshape(6, 20))}
    spec = {(r.i, r.j, r.col): r.v for r in grid.fold(long, ["i", "j"], ["a", "b"], sizes, "spec").collect()}
    assert spec == {k: v for k, v in np.ndenumerate(x.reshape(2, 3, 20))}
    three = {(r.row, r.j, r.rest): r.v for r in grid.fold(long, ["i"], ["j", "a", "b"], sizes, "blocks").collect()}
    assert three == {k: v for k, v in np.ndenumerate(x.reshape(2, 3, 20))}
    assert sorted(r.v for r in grid.picked(long, {"a": 1, "b": 2}).collect()) == sorted(x[:, :, 1, 2].ravel())
    with pytest.raises(NotImplementedError):
        grid.fold(long, [], ["a"], sizes)
    with pytest.raises(NotImplementedError):
        grid.fold(long, ["i"], ["a"], sizes, "blocks")
    with pytest.raises(ValueError):
        grid.fold(long, ["i"], ["a"], sizes, "other")
