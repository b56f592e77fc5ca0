"""Grids of blocks: a row holds a square of pixels, saved in buckets by block.

Saved grids of one layout meet without a shuffle, block by block. A stencil needs a block's neighbours only along its
edges: these halos are the one thing that is exchanged, some hundredths of the pixels, and kernels are vectorised over blocks.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefspark.grid import Grid, GridMeta

SIZE, BUCKETS = 256, 64
KEYS = ["block_row", "block_col"]
#: Sides from which a block gets a halo, as steps to the neighbour.
SIDES = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]


@dataclass(frozen=True)
class BlockGrid:
    """df has block_row, block_col and z: the block's heights along its rows, NaN for no data. Blocks at the right and lower edges are smaller."""

    df: DataFrame
    meta: GridMeta
    size: int = SIZE
    buckets: int = 0

    def height(self) -> Column:
        return F.least(F.lit(self.size), F.lit(self.meta.nrows) - F.col("block_row") * self.size).cast("int")

    def width(self) -> Column:
        return F.least(F.lit(self.size), F.lit(self.meta.ncols) - F.col("block_col") * self.size).cast("int")


def to_blocks(grid: Grid, size: int = SIZE) -> BlockGrid:
    """A grid of pixels as blocks; pixels without a row are no data. A block is one task's: its size is a setting."""
    m = grid.meta

    def build(key, pdf):
        r, c = key
        z = np.full((min(size, m.nrows - r * size), min(size, m.ncols - c * size)), np.nan)
        z[pdf["row"].to_numpy() - r * size, pdf["col"].to_numpy() - c * size] = pdf["z"].to_numpy(float)
        return pd.DataFrame({"block_row": [r], "block_col": [c], "z": [z.ravel()]})

    keys = [F.floor(F.col(a) / size).alias(k) for a, k in zip(("row", "col"), KEYS)]
    return BlockGrid(grid.df.select("row", "col", "z").groupBy(*keys).applyInPandas(build, "block_row long, block_col long, z array<double>"), m, size)


def pixels(blocks: BlockGrid) -> DataFrame:
    """row, col, z; null for no data."""
    z = F.col("p.z")
    df = blocks.df.select(*KEYS, blocks.width().alias("w"), F.posexplode("z").alias("at", "v"))
    df = df.select(F.struct((F.col("block_row") * blocks.size + F.floor(F.col("at") / F.col("w"))).alias("row"), (F.col("block_col") * blocks.size + F.col("at") % F.col("w")).alias("col"), F.nanvl("v", F.lit(None).cast("double")).alias("z")).alias("p"))
    return df.select("p.row", "p.col", z.alias("z"))


def register(spark: SparkSession, path: str, buckets: int) -> str:
    """A table of the session's catalog over a saved block grid; its name."""
    name = f"blocks_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (block_row BIGINT, block_col BIGINT, z ARRAY<DOUBLE>) USING parquet CLUSTERED BY (block_row, block_col) SORTED BY (block_row, block_col) INTO {buckets} BUCKETS LOCATION '{path}'")
    return name


def save_blocks(blocks: BlockGrid, path: str, buckets: int = BUCKETS) -> BlockGrid:
    """The blocks as files of buckets, with metadata beside them, and reread. Grids to be compared take one number of buckets and one block size."""
    spark = blocks.df.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    by_bucket = blocks.df.select(*KEYS, "z").repartition(buckets, *KEYS)  # one file a bucket
    by_bucket.write.mode("overwrite").bucketBy(buckets, *KEYS).sortBy(*KEYS).option("path", f"{path}.blocks").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    m = blocks.meta
    meta = {"nrows": m.nrows, "ncols": m.ncols, "transform": list(m.transform), "crs": m.crs, "nodata": m.nodata, "size": blocks.size, "buckets": buckets}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.blocks.json")
    return load_blocks(spark, path)


def load_blocks(spark: SparkSession, path: str) -> BlockGrid:
    """A grid that save_blocks() wrote, in any session."""
    m = json.loads("".join(r["value"] for r in spark.read.text(f"{path}.blocks.json").collect()))  # one line
    meta = GridMeta(m["nrows"], m["ncols"], tuple(m["transform"]), m["crs"], m["nodata"])
    return BlockGrid(spark.table(register(spark, f"{path}.blocks", m["buckets"])), meta, m["size"], m["buckets"])


def combined(a: BlockGrid, b: BlockGrid, f: Callable[[Column, Column], Column]) -> BlockGrid:
    """f of both grids' heights, pixel by pixel. Saved grids of one layout are joined where they lie: nothing is shuffled."""
    if (a.size, a.meta.nrows, a.meta.ncols) != (b.size, b.meta.nrows, b.meta.ncols):
        raise ValueError("the grids haven't the same size or blocks")
    other = b.df.select(*KEYS, F.col("z").alias("other"))
    return BlockGrid(a.df.join(other, KEYS).select(*KEYS, F.zip_with("z", "other", f).alias("z")), a.meta, a.size, a.buckets)


def alti_diff(ref: BlockGrid, sec: BlockGrid) -> BlockGrid:
    """ref - sec, no data where either is."""
    return combined(ref, sec, lambda x, y: x - y)


def halos(blocks: BlockGrid) -> DataFrame:
    """block_row, block_col, halo: for each block a map of what its neighbours hold along it, by the side's number."""
    z, w, h = F.col("z"), F.col("w"), F.col("h")
    row_at = {0: lambda: F.slice(z, 1, w), -1: lambda: F.slice(z, (h - 1) * w + 1, w)}
    column = lambda first: F.transform(F.sequence(F.lit(0), h - 1), lambda i: F.element_at(z, (i * w + first).cast("int")))
    said = []
    for k, (dr, dc) in enumerate(SIDES):  # the neighbour at -dr, -dc sees this block at dr, dc
        if dr and dc:
            edge = F.array(F.element_at(z, ((F.lit(0) if dr > 0 else h - 1) * w + (F.lit(1) if dc > 0 else w)).cast("int")))
        elif dr:
            edge = row_at[0 if dr > 0 else -1]()
        else:
            edge = column(F.lit(1) if dc > 0 else w)
        said.append(F.struct((F.col("block_row") - dr).alias("block_row"), (F.col("block_col") - dc).alias("block_col"), F.lit(k).alias("side"), edge.alias("edge")))
    sent = blocks.df.select(*KEYS, "z", blocks.width().alias("w"), blocks.height().alias("h")).select(F.explode(F.array(*said)).alias("s")).select("s.*")
    last = [(n - 1) // blocks.size for n in (blocks.meta.nrows, blocks.meta.ncols)]
    sent = sent.filter((F.col("block_row") >= 0) & (F.col("block_col") >= 0) & (F.col("block_row") <= last[0]) & (F.col("block_col") <= last[1]))
    # as many parts as the blocks have, so that those needn't move
    sent = sent.repartition(blocks.buckets, *KEYS) if blocks.buckets else sent
    return sent.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("side", "edge"))).alias("halo"))  # 8 edges


def padded(z: np.ndarray, halo: dict | None) -> np.ndarray:
    """A block with a border of a pixel: its neighbours' where it has them, its own edge pixels at the edge of the grid."""
    out = np.pad(z, 1, mode="edge")
    halo = dict(halo or {})
    # sides first, so that a corner beyond the grid repeats what lies beside it
    for k, (dr, dc) in sorted(enumerate(SIDES), key=lambda s: abs(s[1][0]) + abs(s[1][1])):
        rows, cols = ({-1: slice(0, 1), 0: slice(1, -1), 1: slice(-1, None)}[d] for d in (dr, dc))
        if k in halo:
            edge = np.asarray(halo[k], float)
            out[rows, cols] = edge.reshape(out[rows, cols].shape)
        elif dr and dc:
            up, aside = SIDES.index((dr, 0)) in halo, SIDES.index((0, dc)) in halo
            if up:
                out[rows, cols] = out[rows, slice(1, 2) if dc < 0 else slice(-2, -1)]
            elif aside:
                out[rows, cols] = out[slice(1, 2) if dr < 0 else slice(-2, -1), cols]
    return out


def stencil(blocks: BlockGrid, kernel: Callable[[np.ndarray, dict], dict[str, np.ndarray]], names: list[str]) -> DataFrame:
    """block_row, block_col, w and an array for each name: kernel(block with its border, what it is told) of every block.

    The kernel is told `ends`: whether the block lies at the grid's upper, lower, left and right edge. One exchange, of
    halos, feeds it if the blocks were saved.
    """
    size, m = blocks.size, blocks.meta
    last = [(n - 1) // size for n in (m.nrows, m.ncols)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r, c, z, halo in zip(pdf["block_row"], pdf["block_col"], pdf["z"], pdf["halo"]):
                width = min(size, m.ncols - c * size)
                ends = {"up": r == 0, "down": r == last[0], "left": c == 0, "right": c == last[1]}
                made = kernel(padded(np.asarray(z, float).reshape(-1, width), halo), ends)
                out.append((r, c, width, *[made[n].ravel() for n in names]))
            yield pd.DataFrame(out, columns=[*KEYS, "w", *names])

    met = blocks.df.select(*KEYS, "z").join(halos(blocks), KEYS, "left")
    return met.mapInPandas(run, "block_row long, block_col long, w int, " + ", ".join(f"{n} array<double>" for n in names))


def values(df: DataFrame, size: int, names: list[str]) -> DataFrame:
    """row, col and the named values of stencil()'s arrays, pixel by pixel; null for NaN."""
    zipped = F.posexplode(F.arrays_zip(*names)).alias("at", "v")
    df = df.select(*KEYS, "w", zipped)
    none = F.lit(None).cast("double")
    return df.select((F.col("block_row") * size + F.floor(F.col("at") / F.col("w"))).alias("row"), (F.col("block_col") * size + F.col("at") % F.col("w")).alias("col"), *[F.nanvl(F.col(f"v.{n}"), none).alias(n) for n in names])


def differences(p: np.ndarray, ends: dict) -> tuple[np.ndarray, np.ndarray]:
    """d_row, d_col of the inner pixels: half the difference of both neighbours, one-sided at the grid's edges."""
    d_row, d_col = p[2:, 1:-1] - p[:-2, 1:-1], p[1:-1, 2:] - p[1:-1, :-2]
    down, across = np.full(d_row.shape[0], 2.0), np.full(d_col.shape[1], 2.0)
    for steps, first, end in ((down, "up", "down"), (across, "left", "right")):
        steps[0], steps[-1] = (1.0 if ends[first] else steps[0]), (1.0 if ends[end] else steps[-1])
    return d_row / down[:, None], d_col / across[None, :]


def gradient(blocks: BlockGrid) -> DataFrame:
    """row, col, d_row, d_col."""
    return values(stencil(blocks, lambda p, ends: dict(zip(("d_row", "d_col"), differences(p, ends))), ["d_row", "d_col"]), blocks.size, ["d_row", "d_col"])


def slope(blocks: BlockGrid) -> DataFrame:
    """row, col, slope: 100 x the angle in radians, of a projected grid."""
    if not blocks.meta.is_projected:
        raise ValueError("slopes of blocks need a projected grid")
    dx, dy = abs(blocks.meta.xres), abs(blocks.meta.yres)

    def kernel(p, ends):
        level, smooth = p[:, :-2] - p[:, 2:], p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
        gx, gy = level[:-2] + 2 * level[1:-1] + level[2:], smooth[:-2] - smooth[2:]
        return {"slope": np.arctan(np.sqrt((gx / dx) ** 2 + (gy / dy) ** 2) / 8) * 100}

    return values(stencil(blocks, kernel, ["slope"]), blocks.size, ["slope"])


def normals(blocks: BlockGrid) -> DataFrame:
    """row, col, n_x, n_y, n_z."""
    dx, dy = abs(blocks.meta.xres), abs(blocks.meta.yres)

    def kernel(p, ends):
        d_row, d_col = differences(p, ends)
        x, y = -d_col / dx, -d_row / dy
        norm = np.sqrt(x * x + y * y + 1)
        return {"n_x": x / norm, "n_y": y / norm, "n_z": 1 / norm}

    names = ["n_x", "n_y", "n_z"]
    return values(stencil(blocks, kernel, names), blocks.size, names)


def hillshade(blocks: BlockGrid, azimuth: float = 315.0, angle_altitude: float = 45.0) -> DataFrame:
    """row, col, z: 0 to 255, null where the grid has no data."""
    az, alt = math.radians(azimuth), math.radians(angle_altitude)

    def kernel(p, ends):
        d_row, d_col = differences(p, ends)
        steep, aspect = math.pi / 2 - np.arctan(np.sqrt(d_row**2 + d_col**2)), np.arctan2(-d_row, d_col)
        lit = (math.sin(alt) * np.sin(steep) + math.cos(alt) * np.cos(steep) * np.cos(az - aspect) + 1) * 255 / 2
        return {"z": np.where(np.isnan(p[1:-1, 1:-1]), np.nan, lit)}

    return values(stencil(blocks, kernel, ["z"]), blocks.size, ["z"])
