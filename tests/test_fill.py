"""The nearest fill: lower envelopes against all distances, and time in proportion to pixels."""

import time

import numpy as np
import pytest

from reliefspark.grid import Grid, GridMeta
from reliefspark.operators import resample


def by_columns(z):
    """Row of each pixel's nearest valid one in its column (the upper of two), -1 for none."""
    rows = np.arange(len(z))
    out = np.full(z.shape, -1)
    for c in range(z.shape[1]):
        valid = np.flatnonzero(~np.isnan(z[:, c]))
        if len(valid):
            out[:, c] = valid[np.argmin(abs(rows[:, None] - valid) * 2 + (valid > rows[:, None]), axis=1)]
    return out


def by_all_distances(z):
    out = np.full(z.shape, np.nan)
    valid = np.argwhere(~np.isnan(z))
    for (r, c), _ in np.ndenumerate(z):
        if len(valid):
            i, j = min(map(tuple, valid), key=lambda p: ((p[0] - r) ** 2 + (p[1] - c) ** 2, p))
            out[r, c] = z[i, j]
    return out


@pytest.mark.parametrize("seed", range(30))
def test_envelopes_find_the_nearest_with_ties(seed):
    rng = np.random.default_rng(seed)
    shape = tuple(rng.integers(1, 14, 2))
    z = np.where(rng.random(shape) < rng.choice([0.02, 0.1, 0.3, 0.8]), rng.normal(size=shape), np.nan)
    if seed % 5 == 0:  # a lattice, full of ties
        z = np.where((np.add.outer(np.arange(shape[0]), np.arange(shape[1])) % 4 == 0), rng.normal(size=shape), np.nan)
    found = by_columns(z)
    values = np.where(found >= 0, z[np.maximum(found, 0), np.arange(shape[1])], np.nan)
    got = resample.filled_lines(np.arange(shape[0]), found, values)
    assert np.array_equal(got, by_all_distances(z), equal_nan=True)


def test_time_grows_with_pixels_not_with_holes():
    took = []
    for n in (500, 2000):
        found = np.full((n, n), -1)
        found[:, 0], found[:, -1] = np.arange(n), np.arange(n) // 2
        began = time.process_time()
        resample.filled_lines(np.arange(n), found, np.broadcast_to(np.arange(n, dtype=float), (n, n)))
        took.append(time.process_time() - began)
    assert took[1] < 16 * max(took[0], 0.05) * 2.5  # 16 times the pixels


def test_fill_of_a_grid_without_and_with_little_data(spark):
    rng = np.random.default_rng(1)
    z = np.where(rng.random((40, 60)) < 0.01, rng.normal(size=(40, 60)), np.nan)
    for values in (z, np.full((3, 4), np.nan)):
        rows = [(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(values)]
        got = resample.nearest_fill(Grid(spark.createDataFrame(rows, "row long, col long, z double"), GridMeta(*values.shape))).collect()
        want = by_all_distances(values)
        assert len(got) == values.size and all((r["z"] is None and np.isnan(want[r["row"], r["col"]])) or r["z"] == want[r["row"], r["col"]] for r in got)
