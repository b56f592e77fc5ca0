"""The raster source and sink, against files written by hand in bytes."""

import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reliefspark.grid import Grid, GridMeta
from reliefspark.plans import pipeline
from reliefspark.sources import geotiff
from reliefspark.sources.grids import load_grid

KINDS = {"u": 1, "i": 2, "f": 3}


def lzw(data):
    """Codes of growing width, as the format's description has them."""
    bits, table, free, width, old = [], {bytes([k]): k for k in range(256)}, 258, 9, b""
    bits.append((256, 9))
    for b in data:
        longer = old + bytes([b])
        if longer in table:
            old = longer
            continue
        bits.append((table[old], width))
        table[longer], free, old = free, free + 1, bytes([b])
        if free == 4095:
            bits.append((256, width))
            table, free, width = {bytes([k]): k for k in range(256)}, 258, 9
        else:
            width = 9 if free < 512 else 10 if free < 1024 else 11 if free < 2048 else 12
    bits += [(table[old], width)] if old else []
    bits.append((257, width))
    number = size = 0
    for code, w in bits:
        number, size = number << w | code, size + w
    return (number << -size % 8).to_bytes((size + 7) // 8, "big")


def packbits(data):
    """Runs of a byte, else stretches as they are, and a byte that says nothing."""
    out, at = b"\x80", 0
    while at < len(data):
        run = next((k for k in range(at, min(len(data), at + 128)) if data[k] != data[at]), min(len(data), at + 128)) - at
        out += bytes([257 - run, data[at]]) if run > 1 else bytes([0, data[at]])
        at += run
    return out


def encode(block, compression, predictor, order):
    """Bytes of a block of rows x columns x samples."""
    kind = block.dtype
    if predictor == 2:
        whole = np.dtype(f"u{kind.itemsize}")
        v = block.view(whole)
        block = np.concatenate([v[:, :1], v[:, 1:] - v[:, :-1]], 1).astype(whole.newbyteorder(order))
        data = block.tobytes()
    elif predictor == 3:
        rows, cols, samples = block.shape
        planes = np.ascontiguousarray(block.astype(kind.newbyteorder(">"))).view(np.uint8).reshape(rows, cols * samples, kind.itemsize).transpose(0, 2, 1).reshape(rows, -1, samples)
        data = np.concatenate([planes[:, :1], planes[:, 1:] - planes[:, :-1]], 1).tobytes()
    else:
        data = block.astype(kind.newbyteorder(order)).tobytes()
    return {1: lambda d: d, 5: lzw, 8: zlib.compress, 32773: packbits}[compression](data)


def tiff(path, cube, tile=None, strip=None, compression=1, predictor=1, apart=False, order="<", big=False, tags=None, missing=()):
    """A file of rows x columns x bands, by hand. tags: more tags by number, as (type, values)."""
    rows, cols, bands = cube.shape
    planes = [cube[:, :, b : b + 1] for b in range(bands)] if apart else [cube]
    blocks = []
    for plane in planes:
        for r in range(0, rows, tile or strip):
            for c in range(0, cols, tile or cols):
                part = plane[r : r + (tile or strip), c : c + (tile or cols)]
                if tile:
                    part = np.pad(part, ((0, tile - part.shape[0]), (0, tile - part.shape[1]), (0, 0)), mode="edge")
                blocks.append(b"" if len(blocks) in missing else encode(np.ascontiguousarray(part), compression, predictor, order))
    bits = cube.dtype.itemsize * 8
    t = {256: (3, [cols]), 257: (3, [rows]), 258: (3, [bits] * bands), 259: (3, [compression]), 262: (3, [1]), 277: (3, [bands]), 284: (3, [2 if apart else 1]), 317: (3, [predictor]), 339: (3, [KINDS[cube.dtype.kind]] * bands)}
    t |= {322: (3, [tile]), 323: (3, [tile])} if tile else {278: (3, [strip])}
    kind = 16 if big else 4
    where, sizes = (324, 325) if tile else (273, 279)
    t |= {where: (kind, [0] * len(blocks)), sizes: (kind, [len(b) for b in blocks])} | (tags or {})
    fixed = {2: "s", 3: "H", 4: "I", 12: "d", 16: "Q"}

    def build(at):
        t[where] = (kind, [(at := at + len(b)) - len(b) if b else 0 for b in blocks])
        head = struct.pack(f"{order}2sHHHQ", b"II" if order == "<" else b"MM", 43, 8, 0, 16) if big else struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 8)
        entry, inline = (20, 8) if big else (12, 4)
        start = len(head) + (8 if big else 2) + entry * len(t) + inline
        table, beyond = struct.pack(f"{order}{'Q' if big else 'H'}", len(t)), b""
        for tag, (k, v) in sorted(t.items()):
            raw = v if k == 2 else struct.pack(f"{order}{len(v)}{fixed[k]}", *v)
            held = raw.ljust(inline, b"\0") if len(raw) <= inline else struct.pack(f"{order}{'Q' if big else 'I'}", start + len(beyond))
            beyond += raw if len(raw) > inline else b""
            table += struct.pack(f"{order}HH{'Q' if big else 'I'}", tag, k, len(v)) + held
        return head + table + b"\0" * inline + beyond

    whole = build(len(build(0)))
    with open(path, "wb") as f:
        f.write(whole + b"".join(blocks))
    return str(path)


def cube_of(df, shape):
    out = np.full(shape, np.nan)
    rows = df.collect()
    for r, c, b, z in rows:
        out[r, c, b - 1] = z
    assert len(rows) == int(np.prod(shape))
    return out


CASES = [
    ("float32", {"strip": 5}), ("float64", {"strip": 7, "order": ">"}), ("int16", {"tile": 16, "compression": 8, "predictor": 2}), ("uint8", {"tile": 16, "compression": 5}), ("float32", {"tile": 16, "compression": 8, "predictor": 3}),
    ("float32", {"strip": 4, "compression": 5, "predictor": 3, "order": ">"}), ("uint16", {"strip": 3, "compression": 32773, "apart": True}), ("int32", {"tile": 16, "compression": 8, "predictor": 2, "big": True, "order": ">"}), ("float64", {"tile": 32, "apart": True, "big": True}),
]


@pytest.mark.parametrize(("kind", "how"), CASES)
def test_files_of_all_layouts(spark, tmp_path, kind, how):
    rng = np.random.default_rng(len(kind))
    cube = np.cumsum(rng.integers(0, 9, (37, 41, 3)), 1).astype(kind)
    path = tiff(tmp_path / "a.tif", cube, **how)
    assert (cube_of(geotiff.read_raster(spark, path, None), cube.shape) == cube).all()
    part = geotiff.read_raster(spark, path, 2, (10, 20), (3, 33)).collect()
    assert {(r, c, b): z for r, c, b, z in part} == {(r, c, 2): float(cube[r, c, 1]) for r in range(10, 20) for c in range(3, 33)}


def test_region_reads_its_blocks_only(tmp_path):
    cube = np.arange(64 * 96, dtype="float32").reshape(64, 96, 1)
    path = tiff(tmp_path / "a.tif", cube, tile=16)
    blocks = lambda **o: len(geotiff.GeoTiffReader({"path": path, **o}).blocks())
    assert blocks() == 24 and blocks(row_min=16, row_max=32, col_min=17, col_max=18) == 1 and blocks(row_min=15, row_max=17) == 12 and blocks(row_min=70) == 0
    reader = geotiff.PushingReader({"path": path})
    pushed = [geotiff.GreaterThanOrEqual(("row",), 16), geotiff.LessThan(("row",), 32), geotiff.LessThanOrEqual(("col",), 16), geotiff.GreaterThan(("z",), 3.0)]
    assert list(reader.pushFilters(pushed)) == pushed and len(reader.blocks()) == 2
    assert len(geotiff.GeoTiffReader({"path": tiff(tmp_path / "b.tif", np.zeros((64, 96, 3), "uint8"), tile=16, apart=True), "band": 3}).blocks()) == 24


def test_filters_are_pushed_where_the_session_allows(spark, tmp_path):
    path = tiff(tmp_path / "a.tif", np.arange(64 * 64, dtype="int32").reshape(64, 64, 1), tile=16)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = geotiff.read_raster(spark, path).filter("row >= 16 and row < 32 and col = 5")
        assert sorted(r["z"] for r in df.collect()) == [float(64 * r + 5) for r in range(16, 32)]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_tags_become_metadata(tmp_path):
    cube = np.zeros((4, 6, 1), "float32")
    utm = {33550: (12, [500.0, 250.0, 0.0]), 33922: (12, [0.0, 0.0, 0.0, 1000.0, 9000.0, 0.0]), 34735: (3, [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 32630]), 42113: (2, b"-32768\0")}
    m = geotiff.raster_meta(tiff(tmp_path / "a.tif", cube, strip=4, tags=utm))
    assert (m.nrows, m.ncols, m.transform, m.crs, m.nodata) == (4, 6, (1000.0, 500.0, 0.0, 9000.0, 0.0, -250.0), "EPSG:32630", -32768.0)
    point = utm | {34735: (3, [1, 1, 0, 2, 1025, 0, 1, 2, 2048, 0, 1, 4326]), 42113: (2, b"nan\0")}
    m = geotiff.raster_meta(tiff(tmp_path / "b.tif", cube, strip=4, tags=point))
    assert (m.transform, m.crs) == ((750.0, 500.0, 0.0, 9125.0, 0.0, -250.0), "EPSG:4326") and np.isnan(m.nodata)
    turned = {34264: (12, [0.5, 0.1, 0, 10, 0.2, -0.5, 0, 20, 0, 0, 0, 0, 0, 0, 0, 1])}
    assert geotiff.raster_meta(tiff(tmp_path / "c.tif", cube, strip=4, tags=turned)).transform == (10.0, 0.5, 0.1, 20.0, 0.2, -0.5)


def test_what_cannot_be_read_is_refused(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(b"not a raster")
    (tmp_path / "e.tif").write_bytes(b"")
    for bad in ("a", "e"):
        with pytest.raises(ValueError, match="TIFF"):
            geotiff.header(f"{tmp_path}/{bad}.tif")
    path = tiff(tmp_path / "b.tif", np.zeros((2, 2, 1), "float32"), strip=2, tags={259: (3, [7])})
    with pytest.raises(ValueError, match="compression 7"):
        geotiff.header(path)
    path = tiff(tmp_path / "c.tif", np.zeros((2, 2, 1), "float32"), strip=2)
    with pytest.raises(Exception, match="1 bands"):
        geotiff.read_raster(spark, path, 2).collect()


def test_unstored_blocks_are_no_data(spark, tmp_path):
    cube = np.arange(32 * 32, dtype="float32").reshape(32, 32, 1)
    path = tiff(tmp_path / "a.tif", cube, tile=16, missing={1}, tags={42113: (2, b"-5\0")})
    got = cube_of(geotiff.read_raster(spark, path), cube.shape)
    want = cube.copy()
    want[:16, 16:] = -5
    assert (got == want).all()


def test_load_grid_reads_rasters_with_planes_and_region(spark, tmp_path):
    rng = np.random.default_rng(1)
    z, plane = rng.normal(size=(50, 60, 1)).astype("float32"), rng.integers(0, 4, (50, 60, 1)).astype("uint8")
    z[3, 4] = -9999
    tags = {33550: (12, [10.0, 10.0, 0.0]), 33922: (12, [0.0, 0.0, 0.0, 0.0, 0.0, 0.0]), 34735: (3, [1, 1, 0, 1, 3072, 0, 1, 32631]), 42113: (2, b"-9999\0")}
    cfg = {"path": tiff(tmp_path / "z.tif", z, tile=16, compression=8, tags=tags), "zunit": "cm", "classification_layers": {"land": {"map_path": tiff(tmp_path / "land.tif", plane, strip=8)}}}
    g = load_grid(spark, cfg)
    assert (g.meta.nrows, g.meta.ncols, g.meta.crs, g.labels) == (50, 60, "EPSG:32631", ("land",))
    rows = {(r["row"], r["col"]): (r["z"], r["land"]) for r in g.df.collect()}
    assert len(rows) == 3000 and rows[3, 4] == (None, float(plane[3, 4, 0])) and rows[7, 9] == (pytest.approx(float(z[7, 9, 0]) * 0.01), float(plane[7, 9, 0]))
    part = load_grid(spark, {**cfg, "roi": {"x": 20, "y": 30, "w": 8, "h": 9}})
    assert (part.meta.nrows, part.meta.ncols, part.meta.transform) == (9, 8, (200.0, 10.0, 0.0, -300.0, 0.0, -10.0))
    assert {(r["row"], r["col"]): (r["z"], r["land"]) for r in part.df.collect()} == {(r - 30, c - 20): v for (r, c), v in rows.items() if 30 <= r < 39 and 20 <= c < 28}
    bad = {**cfg, "classification_layers": {"land": {"map_path": tiff(tmp_path / "small.tif", plane[:10], strip=8)}}}
    with pytest.raises(ValueError, match="size"):
        load_grid(spark, bad)


def grid_of(spark, values, **meta):
    rows = [(r, c, float(v) if np.isfinite(v) else None) for (r, c), v in np.ndenumerate(values)]
    return Grid(spark.createDataFrame(rows, "row long, col long, z double"), GridMeta(*values.shape, **meta))


@pytest.mark.parametrize("kind", ["float32", "float64", "int16"])
def test_sink_and_source_agree(spark, tmp_path, kind):
    values = np.round(np.random.default_rng(3).normal(size=(45, 70)) * 50)
    values[2, 3] = np.nan
    g = grid_of(spark, values, transform=(100.0, 2.0, 0.0, 900.0, 0.0, -3.0), crs="EPSG:32630", nodata=-999.0)
    path = str(tmp_path / "out" / "g.tif")
    for _ in range(2):  # again, over the file
        geotiff.write_raster(g, path, block=16, dtype=kind)
    assert os.listdir(tmp_path / "out") == ["g.tif"]
    back = load_grid(spark, {"path": path})
    assert back.meta.transform == g.meta.transform and (back.meta.crs, back.meta.nodata) == ("EPSG:32630", -999.0)
    got = {(r["row"], r["col"]): r["z"] for r in back.df.collect()}
    assert len(got) == values.size and all((got[k] is None) if np.isnan(v) else got[k] == v for k, v in np.ndenumerate(values))


def test_sink_of_bands_and_of_holes(spark, tmp_path):
    cube = np.arange(40 * 40 * 2, dtype=float).reshape(40, 40, 2)
    rows = [(r, c, b + 1, float(v)) for (r, c, b), v in np.ndenumerate(cube) if not (r < 16 and c < 16 and b == 1)]
    g = Grid(spark.createDataFrame(rows, "row long, col long, band int, z double"), GridMeta(40, 40, nodata=-1.0))
    path = str(tmp_path / "g.tif")
    geotiff.write_raster(g, path, block=16, bands=2)
    cube[:16, :16, 1] = -1
    assert (cube_of(geotiff.read_raster(spark, path, None), cube.shape) == cube).all() and (geotiff.header(path).counts == 0).sum() == 1


def test_failed_writes_leave_no_file(spark, tmp_path):
    g = grid_of(spark, np.zeros((20, 20)))
    with pytest.raises(Exception, match="outside the raster"):
        geotiff.write_raster(Grid(g.df.withColumn("row", F.col("row") + 5), g.meta), str(tmp_path / "g.tif"), block=16)
    assert os.listdir(tmp_path) == []


def test_runs_read_and_write_rasters(spark, tmp_path):
    r, c = np.mgrid[:40, :50]
    surface = lambda dr, dc: (np.sin((r + dr) / 9) * 20 + np.cos((c + dc) / 7) * 15 + np.sin((r + c + dr + dc) / 15) * 10)[:, :, None].astype("float64")
    tags = {33550: (12, [1.0, 1.0, 0.0]), 33922: (12, [0.0, 0.0, 0.0, 0.0, 0.0, 0.0]), 34735: (3, [1, 1, 0, 1, 3072, 0, 1, 32631])}
    cfg = {
        "input_ref": {"path": tiff(tmp_path / "ref.tif", surface(0, 0), tile=16, compression=8, tags=tags)}, "input_sec": {"path": tiff(tmp_path / "sec.tif", surface(1, 2), strip=9, tags=tags)},
        "coregistration": {"number_of_iterations": 3}, "statistics": {"alti-diff": {"metrics": ["mean"]}}, "output_dir": str(tmp_path / "out"), "raster_outputs": True,
    }
    _, results = pipeline.run(spark, cfg)
    assert results["dx"]["nuth_offset"] == pytest.approx(2, abs=0.1) and results["dy"]["nuth_offset"] == pytest.approx(1, abs=0.1)
    for name in ("coregistration/reproj_coreg_REF", "coregistration/reproj_coreg_SEC", "stats/alti-diff/dem_for_stats"):
        raster, table = load_grid(spark, {"path": f"{tmp_path}/out/{name}.tif"}), spark.read.parquet(f"{tmp_path}/out/{name}.parquet")
        both = raster.df.join(table.select("row", "col", F.col("z").alias("t")), ["row", "col"]).filter("not (z <=> cast(t as float))").count()
        assert both == 0 and raster.df.count() == table.count(), name
    assert json.loads(spark.read.text(f"{tmp_path}/out/coregistration/reproj_coreg_REF.meta.json").first()[0])["nrows"] == raster.meta.nrows
