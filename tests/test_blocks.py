"""Block grids against the operators over pixels; what their plans shuffle."""

import numpy as np
import pytest

from reliefspark.grid import Grid, GridMeta
from reliefspark.operators import blocks, processing, stencil


def grid(spark, shape, seed=0, holes=0.05):
    rng = np.random.default_rng(seed)
    z = np.where(rng.random(shape) < holes, np.nan, rng.normal(size=shape) * 30)
    rows = [(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(z)]
    return Grid(spark.createDataFrame(rows, "row long, col long, z double"), GridMeta(*shape, (0.0, 20.0, 0.0, 0.0, 0.0, -25.0), "EPSG:32631"))


def same(a, b, names):
    left, right = ({(r["row"], r["col"]): [r[n] for n in names] for r in df.collect()} for df in (a, b))
    assert set(left) == set(right) and len(left)
    for k, v in left.items():
        for x, y in zip(v, right[k]):
            assert (x is None and y is None) or x == pytest.approx(y, abs=1e-9), k


@pytest.mark.parametrize("shape", [(37, 50), (16, 16), (1, 20), (20, 1), (8, 17)])
def test_stencils_of_blocks_are_those_of_pixels(spark, shape):
    g = grid(spark, shape, sum(shape))
    b = blocks.to_blocks(g, 8)
    same(blocks.pixels(b), g.z(), ["z"])
    same(blocks.slope(b), stencil.slope(g).df, ["slope"])
    same(blocks.gradient(b), stencil.gradient(g), ["d_row", "d_col"])
    same(blocks.normals(b), stencil.normals(g), ["n_x", "n_y", "n_z"])
    same(blocks.hillshade(b), stencil.hillshade(g), ["z"])


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange RoundRobin") + plan.count("BroadcastExchange") + plan.count("Exchange SinglePartition")


def test_saved_grids_meet_without_a_shuffle(spark, tmp_path):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ref, sec = grid(spark, (40, 60), 1), grid(spark, (40, 60), 2)
        a, b = (blocks.save_blocks(blocks.to_blocks(g, 8), f"{tmp_path}/{n}", 6) for n, g in (("a", ref), ("b", sec)))
        d = blocks.alti_diff(a, b)
        assert exchanges(d.df) == 0
        same(blocks.pixels(d), processing.process("alti-diff", ref, sec).z(), ["z"])
        shaded = blocks.hillshade(a)
        assert exchanges(shaded) == 1  # halos
        same(shaded, stencil.hillshade(ref), ["z"])
        again = blocks.load_blocks(spark, f"{tmp_path}/a")
        assert (again.meta.transform, again.size, again.buckets) == (ref.meta.transform, 8, 6) and exchanges(blocks.alti_diff(again, b).df) == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_grids_of_other_layouts_are_refused(spark):
    a, b = blocks.to_blocks(grid(spark, (9, 9)), 4), blocks.to_blocks(grid(spark, (9, 9)), 5)
    with pytest.raises(ValueError, match="blocks"):
        blocks.alti_diff(a, b)
    with pytest.raises(ValueError, match="projected"):
        blocks.slope(blocks.BlockGrid(a.df, GridMeta(9, 9), 4))
