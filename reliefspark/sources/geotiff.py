"""GeoTIFF as a data source: blocks of a file are dealt to tasks, blocks outside a region are never read, tasks write their own blocks.

spark.read.format("geotiff") gives row, col, band, z; spark.write.format("geotiff") takes them. Classic and big files;
strips and tiles; samples side by side or band by band; raw, deflate, LZW, PackBits and zstandard blocks; both predictors.
"""

from __future__ import annotations

import json
import math
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from reliefspark.grid import GEOGRAPHIC, NODATA, Grid, GridMeta

#: TIFF tags and codes, and the formats and sizes of the types of their values.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT, PIXEL_SCALE, TIEPOINT, TRANSFORMATION, GEO_KEYS, GDAL_NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 42113
GEO_MODEL, GEO_RASTER, GEO_GEOGRAPHIC, GEO_PROJECTED = 1024, 1025, 2048, 3072
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("B", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 13: ("I", 4), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}
RAW, LZW, DEFLATE, OLD_DEFLATE, PACKBITS, ZSTD = 1, 5, 8, 32946, 32773, 50000

SCHEMA = "row long, col long, band int, z double"
#: Pixels that a task reads, and pixels of a batch.
PIXELS, BATCH = 500_000, 500_000


def file_at(path: str):
    """A file for reading at places; paths of other systems are those that pyarrow knows."""
    if path.startswith("file:"):
        path = path.removeprefix("file:")
        path = "/" + path.lstrip("/")
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


@dataclass(frozen=True)
class Header:
    """What a file's tags say. Blocks are numbered along rows, band after band if bands are apart."""

    width: int
    height: int
    bands: int
    dtype: str
    block_rows: int
    block_cols: int
    apart: bool
    compression: int
    predictor: int
    offsets: np.ndarray = field(repr=False)
    counts: np.ndarray = field(repr=False)
    transform: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    crs: str = ""
    nodata: float | None = None

    @property
    def across(self) -> int:
        return -(-self.width // self.block_cols)

    @property
    def down(self) -> int:
        return -(-self.height // self.block_rows)

    def block_shape(self) -> tuple[int, int, int]:
        """Rows, columns and samples a pixel of a stored block."""
        return self.block_rows, self.block_cols, 1 if self.apart else self.bands


def tags_of(f) -> tuple[str, dict[int, tuple]]:
    """(byte order, values by tag) of the file's first image."""
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack(f"{order}H", head[2:4])[0] if order and len(head) >= 8 else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    at = struct.unpack(f"{order}Q", head[8:16])[0] if big else struct.unpack(f"{order}I", head[4:8])[0]
    count_format, entry, inline = ("Q", 20, 8) if big else ("H", 12, 4)
    f.seek(at)
    n = struct.unpack(f"{order}{count_format}", f.read(8 if big else 2))[0]
    table, out = f.read(n * entry), {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HH{'Q' if big else 'I'}", table, k * entry)
        if kind not in TYPES:
            continue
        letter, size = TYPES[kind]
        total, place = size * count, k * entry + entry - inline
        if total <= inline:
            raw = table[place : place + total]
        else:
            f.seek(struct.unpack_from(f"{order}{'Q' if big else 'I'}", table, place)[0])
            raw = f.read(total)
        out[tag] = raw if kind == 2 else np.frombuffer(raw, f"{order}u{size}") if letter in "BHIQ" else struct.unpack(f"{order}{count * len(letter)}{letter[0]}", raw)
    return order, out


def header(path: str) -> Header:
    """The header of a file; ValueError for what this source can't read."""
    with file_at(path) as f:
        order, t = tags_of(f)
    one = lambda tag, default: int(t[tag][0]) if tag in t else default
    bands, bits, kind = one(SAMPLES, 1), set(map(int, t.get(BITS, [1]))), set(map(int, t.get(SAMPLE_FORMAT, [1])))
    if len(bits) > 1 or len(kind) > 1 or not bits <= {8, 16, 32, 64} or not kind <= {1, 2, 3}:
        raise ValueError(f"samples of {sorted(bits)} bits and kinds {sorted(kind)} can't be read")
    compression, predictor = one(COMPRESSION, RAW), one(PREDICTOR, 1)
    if compression not in (RAW, LZW, DEFLATE, OLD_DEFLATE, PACKBITS, ZSTD) or predictor not in (1, 2, 3):
        raise ValueError(f"compression {compression} with predictor {predictor} can't be read")
    tiled = TILE_OFFSETS in t
    rows, cols = (one(TILE_LENGTH, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(STRIP_ROWS, 2**32 - 1), one(LENGTH, 0)), one(WIDTH, 0))
    keys = np.array(t.get(GEO_KEYS, [])).reshape(-1, 4)[1:].tolist()
    geo = {k: v for k, place, _, v in keys if place == 0}
    code = next((geo[k] for k in (GEO_PROJECTED, GEO_GEOGRAPHIC) if 0 < geo.get(k, 0) < 32767), None)
    if TRANSFORMATION in t:
        m = t[TRANSFORMATION]
        transform = (m[3], m[0], m[1], m[7], m[4], m[5])
    elif PIXEL_SCALE in t and TIEPOINT in t:
        (sx, sy, *_), (i, j, _, x, y, *_) = t[PIXEL_SCALE], t[TIEPOINT]
        transform = (x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy)
    else:
        transform = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    if geo.get(GEO_RASTER) == 2:  # the tie is a pixel's centre
        c, a, b, g, d, e = transform
        transform = (c - (a + b) / 2, a, b, g - (d + e) / 2, d, e)
    text = t[GDAL_NODATA].split(b"\0")[0].decode().strip() if GDAL_NODATA in t else ""
    dtype = f"{order}{'?uif'[kind.pop()]}{bits.pop() // 8}"
    return Header(
        one(WIDTH, 0), one(LENGTH, 0), bands, dtype, rows, cols, one(PLANAR, 1) == 2 and bands > 1, compression, predictor,
        np.array(t[TILE_OFFSETS if tiled else STRIP_OFFSETS], np.int64), np.array(t[TILE_COUNTS if tiled else STRIP_COUNTS], np.int64),
        tuple(map(float, transform)), f"EPSG:{code}" if code else "", float(text) if text else None,
    )


def unlzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes from 9 bits on, high bits first, one bit more just before the table is full."""
    out, table, old = bytearray(), [], b""
    bits, held, width = 0, 0, 9
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, old = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            raise ValueError("LZW data don't begin with a clear code")
        if old:
            table.append(old + (table[code] if code < len(table) else old)[:1])
        old = table[code]
        out += old
        width = max(9, min(12, (len(table) + 1).bit_length()))
    return bytes(out)


def unpackbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def decoded(data: bytes, h: Header, rows: int) -> np.ndarray:
    """rows x columns x samples of a stored block."""
    _, cols, samples = h.block_shape()
    if h.compression in (DEFLATE, OLD_DEFLATE):
        data = zlib.decompress(data)
    elif h.compression == LZW:
        data = unlzw(data)
    elif h.compression == PACKBITS:
        data = unpackbits(data)
    elif h.compression == ZSTD:
        import zstandard

        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    kind = np.dtype(h.dtype)
    n = rows * cols * samples
    if h.predictor == 3:  # bytes of a row, high ones of all samples first, as differences
        planes = np.frombuffer(data, np.uint8, n * kind.itemsize).reshape(rows, -1, samples).cumsum(1, dtype=np.uint8)
        planes = planes.reshape(rows, kind.itemsize, cols * samples).transpose(0, 2, 1)
        return np.ascontiguousarray(planes).view(kind.newbyteorder(">")).reshape(rows, cols, samples)
    values = np.frombuffer(data, kind, n).reshape(rows, cols, samples)
    if h.predictor == 2:
        whole = np.dtype(f"u{kind.itemsize}")
        values = values.astype(kind.newbyteorder("=")).view(whole).cumsum(1, dtype=whole).view(kind.newbyteorder("="))
    return values


@dataclass
class Blocks(InputPartition):
    """Blocks that one task reads: (number, offset, bytes)."""

    blocks: list[tuple[int, int, int]]


class GeoTiffReader(DataSourceReader):
    """Options: path; band (all without it); row_min, row_max, col_min, col_max, a half-open region."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.head = header(self.path)
        number = lambda key, default: int(options.get(key, default))
        self.rows = [max(0, number("row_min", 0)), min(self.head.height, number("row_max", self.head.height))]
        self.cols = [max(0, number("col_min", 0)), min(self.head.width, number("col_max", self.head.width))]
        self.bands = [int(options["band"])] if "band" in options else list(range(1, self.head.bands + 1))
        if not set(self.bands) <= set(range(1, self.head.bands + 1)):
            raise ValueError(f"the file has {self.head.bands} bands")

    def blocks(self) -> list[tuple[int, int, int]]:
        """Those that hold pixels of the region and bands; one that isn't stored has 0 bytes."""
        h = self.head
        if self.rows[0] >= self.rows[1] or self.cols[0] >= self.cols[1]:
            return []
        downs = range(self.rows[0] // h.block_rows, (self.rows[1] - 1) // h.block_rows + 1)
        acrosses = range(self.cols[0] // h.block_cols, (self.cols[1] - 1) // h.block_cols + 1)
        planes = [b - 1 for b in self.bands] if h.apart else [0] if self.bands else []
        numbers = [(p * h.down + d) * h.across + a for p in planes for d in downs for a in acrosses]
        return [(k, int(h.offsets[k]), int(h.counts[k])) for k in numbers]

    def partitions(self):
        found = self.blocks()
        rows, cols, samples = self.head.block_shape()
        size = max(1, PIXELS // (rows * cols * samples))
        parts = [Blocks(found[k : k + size]) for k in range(0, len(found), size)]
        self.head = Header(**{**self.head.__dict__, "offsets": np.zeros(0, np.int64), "counts": np.zeros(0, np.int64)})  # partitions have theirs
        return parts or [Blocks([])]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        h = self.head
        block_rows, block_cols, _ = h.block_shape()
        with file_at(self.path) as f:
            for number, offset, size in partition.blocks:
                plane, at = divmod(number, h.down * h.across)
                top, left = at // h.across * block_rows, at % h.across * block_cols
                rows = min(block_rows, h.height - top)  # the last strip is shorter; of tiles, the rows beyond the edge aren't needed
                if size:
                    f.seek(offset)
                    values = decoded(f.read(size), h, rows)
                else:
                    values = np.full((rows, block_cols, h.block_shape()[2]), h.nodata if h.nodata is not None else 0, np.float64)
                r0, r1 = max(self.rows[0], top), min(self.rows[1], top + rows, h.height)
                c0, c1 = max(self.cols[0], left), min(self.cols[1], left + block_cols)
                for band in [plane + 1] if h.apart else self.bands:
                    z = values[r0 - top : r1 - top, c0 - left : c1 - left, 0 if h.apart else band - 1].astype(np.float64)
                    step = max(1, BATCH // max(1, c1 - c0))
                    for a in range(0, len(z), step):
                        part = z[a : a + step]
                        row = np.repeat(np.arange(r0 + a, r0 + a + len(part)), c1 - c0)
                        col = np.tile(np.arange(c0, c1), len(part))
                        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(col, pa.int64()), pa.array(np.full(len(row), band), pa.int32()), pa.array(part.ravel())], ["row", "col", "band", "z"])


class PushingReader(GeoTiffReader):
    """A reader for sessions that push filters to Python sources (spark.sql.python.filterPushdown.enabled)."""

    def pushFilters(self, filters):
        """Filters of row, col and band narrow the region; Spark applies all of them again."""
        for f in filters:
            name = getattr(f, "attribute", ())
            if name == ("band",) and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.bands = [b for b in self.bands if b in wanted]
            elif name in (("row",), ("col",)):
                span = self.rows if name == ("row",) else self.cols
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    span[0] = max(span[0], math.floor(f.value) + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    span[1] = min(span[1], math.ceil(f.value) + (not isinstance(f, LessThan)))
            yield f


def layout(height: int, width: int, bands: int, block: int, dtype: str, meta: dict) -> tuple[bytes, int, int, int]:
    """(header with all blocks unstored, places of the blocks' offsets, of their sizes and of the first block) of a big TIFF of square tiles, bands apart."""
    kind = np.dtype(dtype).newbyteorder("<")
    n = bands * -(-height // block) * -(-width // block)
    c, a, b, f, d, e = meta["transform"]
    code = int(meta["crs"].split(":")[1]) if meta["crs"].startswith("EPSG:") and meta["crs"].split(":")[1].isdigit() else 32767
    geographic = meta["crs"] in GEOGRAPHIC
    keys = [1, 1, 0, 3, GEO_MODEL, 0, 1, 2 if geographic else 1, GEO_RASTER, 0, 1, 1, GEO_GEOGRAPHIC if geographic else GEO_PROJECTED, 0, 1, code]
    values = {
        WIDTH: (4, [width]), LENGTH: (4, [height]), BITS: (3, [kind.itemsize * 8] * bands), COMPRESSION: (3, [RAW]), PHOTOMETRIC: (3, [1]), SAMPLES: (3, [bands]), PLANAR: (3, [2 if bands > 1 else 1]),
        TILE_WIDTH: (4, [block]), TILE_LENGTH: (4, [block]), TILE_OFFSETS: (16, [0] * n), TILE_COUNTS: (16, [0] * n), SAMPLE_FORMAT: (3, [{"u": 1, "i": 2, "f": 3}[kind.kind]] * bands),
        TRANSFORMATION: (12, [a, b, 0, c, d, e, 0, f, 0, 0, 0, 0, 0, 0, 0, 1]), GEO_KEYS: (3, keys), GDAL_NODATA: (2, f"{meta['nodata']!r}\0".encode()),
    }
    entries, beyond, places = b"", b"", {}
    start = 16 + 8 + 20 * len(values) + 8
    for tag, (code_, v) in sorted(values.items()):
        raw = v if code_ == 2 else struct.pack(f"<{len(v)}{TYPES[code_][0]}", *v)
        if len(raw) <= 8:
            places[tag] = 16 + 8 + len(entries) + 12
            held = raw.ljust(8, b"\0")
        else:
            places[tag] = start + len(beyond)
            held = struct.pack("<Q", places[tag])
            beyond += raw + b"\0" * (-len(raw) % 8)
        entries += struct.pack("<HHQ", tag, code_, len(v)) + held
    head = b"II" + struct.pack("<HHHQ", 43, 8, 0, 16) + struct.pack("<Q", len(values)) + entries + struct.pack("<Q", 0) + beyond
    return head, places[TILE_OFFSETS], places[TILE_COUNTS], -(-len(head) // 4096) * 4096


@dataclass
class Written(WriterCommitMessage):
    blocks: list[int]


class GeoTiffWriter(DataSourceArrowWriter):
    """Options: path, height, width, bands, block, dtype, meta (JSON: transform, crs, nodata).

    Every block has its place from the start, so tasks write theirs into one file beside the target, and a task that runs
    twice writes the same bytes to the same place. The commit writes the tags and renames; blocks without rows stay unstored.
    """

    def __init__(self, options: dict, overwrite: bool):
        o = options
        path = o["path"].removeprefix("file:")
        if "://" in path:
            raise ValueError("raster files are written in place, so their path must be of a file system that executors have mounted")
        self.path = "/" + path.lstrip("/") if path.startswith("/") else os.path.abspath(path)
        if os.path.exists(self.path) and not overwrite:
            raise ValueError(f"{self.path} exists")
        self.height, self.width, self.bands, self.block, self.dtype = int(o["height"]), int(o["width"]), int(o.get("bands", 1)), int(o.get("block", 256)), o.get("dtype", "float32")
        self.meta = json.loads(o["meta"])
        self.first = layout(self.height, self.width, self.bands, self.block, self.dtype, self.meta)[3]
        self.across, self.down = -(-self.width // self.block), -(-self.height // self.block)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        open(self.part, "wb").close()

    def write(self, iterator) -> Written:
        kind = np.dtype(self.dtype).newbyteorder("<")
        size = self.block * self.block * kind.itemsize
        now, values, done = -1, None, []
        with open(self.part, "r+b") as f:

            def put():
                if now >= 0:
                    f.seek(self.first + now * size)
                    f.write(values.tobytes())
                    done.append(now)

            for batch in iterator:
                row, col, band = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("row", "col", "band"))
                z = batch.column("z").to_numpy(zero_copy_only=False).astype(np.float64)
                z = np.where(np.isnan(z), self.meta["nodata"], z)
                if len(row) and (row.min() < 0 or col.min() < 0 or band.min() < 1 or row.max() >= self.height or col.max() >= self.width or band.max() > self.bands):
                    raise ValueError("a pixel lies outside the raster")
                number = ((band - 1) * self.down + row // self.block) * self.across + col // self.block
                cuts = np.flatnonzero(np.diff(number)) + 1
                for part in np.split(np.arange(len(number)), cuts) if len(number) else []:
                    if number[part[0]] != now:
                        put()
                        now = int(number[part[0]])
                        if now in done:
                            raise ValueError("rows of a block must come together")
                        values = np.full((self.block, self.block), self.meta["nodata"]).astype(kind)
                    values[row[part] % self.block, col[part] % self.block] = z[part]
            put()
        return Written(done)

    def commit(self, messages) -> None:
        size = self.block * self.block * np.dtype(self.dtype).itemsize
        stored = np.zeros(self.bands * self.down * self.across, np.int64)
        for m in messages:
            if m is not None:
                stored[m.blocks] += 1
        if (stored > 1).any():
            self.abort(messages)
            raise ValueError("rows of a block came from several tasks")
        head, offsets, counts, first = layout(self.height, self.width, self.bands, self.block, self.dtype, self.meta)
        with open(self.part, "r+b") as f:
            f.write(head)
            for place, values in ((offsets, first + np.arange(len(stored)) * size), (counts, np.full(len(stored), size))):
                f.seek(place)
                f.write((values * stored).astype("<i8").tobytes())
            f.truncate(first + (int(np.flatnonzero(stored).max()) + 1 if stored.any() else 0) * size)
        os.replace(self.part, self.path)

    def abort(self, messages) -> None:
        if os.path.exists(self.part):
            os.remove(self.part)


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GeoTiffReader:
        return (PushingReader if self.options.get("push") == "true" else GeoTiffReader)(dict(self.options))

    def writer(self, schema, overwrite: bool) -> GeoTiffWriter:
        return GeoTiffWriter(dict(self.options), overwrite)


def raster_meta(path: str) -> GridMeta:
    """Size, transform, coordinate system and no data of a raster file, from its tags."""
    h = header(path)
    return GridMeta(h.height, h.width, h.transform, h.crs or GridMeta.crs, NODATA if h.nodata is None else h.nodata)


def read_raster(spark: SparkSession, path: str, band: int | None = 1, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
    """row, col, band, z of a raster file, of one band or all, within half-open ranges; blocks outside aren't read."""
    spark.dataSource.register(GeoTiff)
    reader = spark.read.format("geotiff").option("path", path).option("push", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    reader = reader.option("band", band) if band is not None else reader
    for axis, span in (("row", rows), ("col", cols)):
        if span:
            reader = reader.option(f"{axis}_min", span[0]).option(f"{axis}_max", span[1])
    return reader.load()


def write_raster(grid: Grid, path: str, block: int = 256, dtype: str = "float32", bands: int = 1, values: str = "z") -> None:
    """A grid as a GeoTIFF of tiles; a null is no data. With `bands`, the grid has a row for each band (column band, from 1).

    Pixels are shuffled once, to the tasks that write their blocks; nothing but block numbers comes to the driver.
    """
    spark = grid.df.sparkSession
    spark.dataSource.register(GeoTiff)
    m = grid.meta
    band = F.col("band").cast("int") if bands > 1 else F.lit(1)
    df = grid.df.select("row", "col", band.alias("band"), F.col(values).cast("double").alias("z"))
    block_of = [F.col("band"), F.floor(F.col("row") / block), F.floor(F.col("col") / block)]
    df = df.repartition(*block_of).sortWithinPartitions(*block_of)
    meta = {"transform": list(m.transform), "crs": m.crs, "nodata": m.nodata}
    options = {"height": m.nrows, "width": m.ncols, "bands": bands, "block": block, "dtype": dtype, "meta": json.dumps(meta)}
    df.write.format("geotiff").mode("overwrite").options(**options).save(path)
