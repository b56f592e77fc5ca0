"""Order statistics of streams, and the data behind the coregistration's plots."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reliefspark.functions import metrics
from reliefspark.grid import Grid, GridMeta
from reliefspark.operators import coregister
from reliefspark.streaming import incremental

SCHEMA = "tile long, version int, class_idx int, z double"


def tiles(seed):
    """Tiles by (number, version): rows of pixels."""
    rng = np.random.default_rng(seed)
    scale = lambda: 10.0 ** rng.integers(-2, 4)
    out = {(t, 0): [(t, 0, int(rng.integers(0, 3)), float(z)) for z in rng.normal(size=80) * scale() + rng.normal() * 10] for t in range(12)}
    out[3, 0] += [(3, 0, 1, None), (3, 0, 1, float("nan")), (3, 0, 7, 0.0), (3, 0, 8, -2.5)]
    for t in (2, 5):  # corrected later
        out[t, 1] = [(t, 1, c, z * 3 + 1) for _, _, c, z in out[t, 0][:50]]
    return out


def run(spark, folder, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        incremental.start_cells(stream, f"{folder}/cells", f"{folder}/check").awaitTermination(120)
        assert k >= 0
    return {r["class_idx"]: r for r in incremental.order_bounds(spark.read.parquet(f"{folder}/cells")).collect()}


def test_order_statistics_of_a_stream(spark, tmp_path):
    made = tiles(1)
    last = {t: rows for (t, v), rows in sorted(made.items())}  # the highest version of each tile
    values: dict = {}
    for rows in last.values():
        for _, _, c, z in rows:
            if z is not None and not math.isnan(z):
                values.setdefault(c, []).append(z)
    order = sorted(made)
    first = run(spark, f"{tmp_path}/a", [[r for k in order[:6] for r in made[k]], [r for k in order[6:] for r in made[k]]])
    # any order of batches: corrections before what they correct
    again = run(spark, f"{tmp_path}/b", [[r for k in order[::-1][:5] for r in made[k]], [r for k in order[::-1][5:9] for r in made[k]], [r for k in order[::-1][9:] for r in made[k]]])
    whole = spark.createDataFrame([r for rows in last.values() for r in rows], SCHEMA)
    batch = {r["class_idx"]: r for r in incremental.order_bounds(incremental.cells(whole)).collect()}
    assert first == again == batch and set(first) == set(values)
    for c, v in values.items():
        r, median = first[c], np.median(v)
        nmad = 1.4826 * np.median(abs(np.array(v) - median))
        assert r["nbpts"] == len(v) and r["median_low"] <= median <= r["median_high"] and r["nmad_low"] - 1e-12 <= nmad <= r["nmad_high"] + 1e-12
        assert r["median_high"] - r["median_low"] <= 0.05 * max(abs(r["median_high"]), abs(r["median_low"])) + 1e-12
    assert first[7]["median_low"] == first[7]["median_high"] == 0 and first[8]["nmad_high"] == 0


def test_cells_are_in_order_of_values(spark):
    v = sorted([0.0, -1e300, 1e300, 5e-324, -5e-324, 1.0, -1.0, 1.05, 2.0, *np.random.default_rng(0).normal(size=200).tolist()])
    got = [r[1] for r in sorted(spark.createDataFrame([(x,) for x in v], "z double").select("z", incremental.cell_of(F.col("z"))).collect())]
    assert got == sorted(got) and len(set(got)) > 100


def test_fits_of_all_iterations_are_kept(spark):
    r, c = np.mgrid[:40, :50].astype(float)
    surface = lambda r, c: np.sin(r / 9) * 20 + np.cos(c / 7) * 15 + np.sin((r + c) / 15) * 10
    meta = GridMeta(40, 50, (0.0, 1.0, 0.0, 0.0, 0.0, -1.0), "EPSG:32631")
    made = [Grid(spark.createDataFrame([(int(a), int(b), float(z[a, b])) for a in range(40) for b in range(50)], "row long, col long, z double"), meta) for z in (surface(r, c), surface(r + 1, c + 2))]
    done = coregister.coregister(made[1], made[0], iterations=3)
    rows = done.fit_table().collect()
    assert {x["iteration"] for x in rows} == {0, 1, 2} and all(x["aspect"] == pytest.approx(x["slice"] * math.pi / 36) for x in rows)
    by = {k: [x for x in rows if x["iteration"] == k] for k in range(3)}
    assert sum({x["iteration"]: x["east"] for x in rows}.values()) == pytest.approx(done.transformation.x_offset)
    for k, own in by.items():
        east, north, cc = coregister.fit([(x["slice"], x["median"]) for x in own])
        assert all(x["fitted"] == pytest.approx(north * math.cos(x["aspect"]) + east * math.sin(x["aspect"]) + cc) for x in own), k
    turned = metrics.polar(metrics.vector_metric("slope-orientation-histogram")(made[0], 1.0, 1.0, 36)).collect()
    assert len(turned) == 36 and sum(x["value"] for x in turned) == 2000 and all(x["theta"] == pytest.approx(math.pi / 2 - math.radians(x["degrees"])) for x in turned)
