"""GeoTIFF as a data source: one partition a strip or tile, cells as rows, windows pushed down to the blocks read.

``spark.read.format("geotiff").load(path)`` gives ``(row, col, b1, b2, ...)``. The format is read here from
its public description: classic and big files, strips and tiles, no compression, deflate or LZW, the two
predictors, nodata, the projection's code and the transform. Files are opened by pyarrow, so any store that it
knows will do; a task reads the bytes of its own block only.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from terrastrat.session import written
from terrastrat.sources.files import check_masks

# fixed values of the file format: sizes and codes of field types, and the tags that are used
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _OFFSETS, _SAMPLES, _STRIP_ROWS, _COUNTS, _PLANAR, _PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
_PHOTOMETRIC, _TILE_WIDTH, _TILE_HEIGHT, _TILE_OFFSETS, _TILE_COUNTS, _EXTRA, _FORMAT = 262, 322, 323, 324, 325, 338, 339
_SCALE, _TIE, _MATRIX, _GEO_KEYS, _METADATA, _NODATA = 33550, 33922, 34264, 34735, 42112, 42113
_PROJECTED, _GEOGRAPHIC, _PIXEL_IS = 3072, 2048, 1025
_CODES = {"none": 1, "lzw": 5, "deflate": 8}
_KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


def opened(path: str):
    """(file system, path in it) of a path or URI."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1))


@dataclass(frozen=True)
class Grid:
    """Size, place and projection of a raster."""

    width: int
    height: int
    transform: tuple
    epsg: int | None = None

    def mismatches(self, other: Grid) -> list[str]:
        """What differs between two grids."""
        out = [f"{n}: {getattr(self, n)} and {getattr(other, n)}" for n in ("width", "height", "epsg") if getattr(self, n) != getattr(other, n)]
        return out + [f"transform: {self.transform} and {other.transform}"] * (not np.allclose(self.transform, other.transform, rtol=1e-9, atol=1e-6))


@dataclass(frozen=True)
class Layout:
    """What a file's header says."""

    grid: Grid
    bands: int
    kind: str
    order: str
    compression: int
    predictor: int
    separate: bool
    tiled: bool
    block: tuple
    offsets: tuple
    counts: tuple
    nodata: float | None
    tags: dict = field(default_factory=dict)

    @property
    def across(self) -> int:
        return -(-self.grid.width // self.block[1])

    @property
    def down(self) -> int:
        return -(-self.grid.height // self.block[0])


def layout_of(path: str) -> Layout:
    """The header of a file; raises ValueError where the format isn't one that can be read."""
    store, place = opened(path)
    with store.open_input_file(place) as f:
        order = {b"II": "<", b"MM": ">"}.get(f.read_at(2, 0))
        if not order:
            raise ValueError(f"{path} is not a TIFF file")
        big = struct.unpack(order + "H", f.read_at(2, 2))[0] == 43
        at = struct.unpack(order + ("Q" if big else "I"), f.read_at(8 if big else 4, 8 if big else 4))[0]
        head, entry, count = (8, 20, "Q") if big else (2, 12, "I")
        n = struct.unpack(order + ("Q" if big else "H"), f.read_at(head, at))[0]
        raw, found = f.read_at(n * entry, at + head), {}
        for i in range(n):
            tag, kind = struct.unpack_from(order + "HH", raw, i * entry)
            size = struct.unpack_from(order + count, raw, i * entry + 4)[0]
            if kind not in _TYPES:
                continue
            form = f"{order}{size}s" if kind == 2 else f"{order}{size * len(_TYPES[kind])}{_TYPES[kind][0]}"
            inside, most = (12, 8) if big else (8, 4)
            body = raw[i * entry + inside : i * entry + inside + most]
            if struct.calcsize(form) > most:
                body = f.read_at(struct.calcsize(form), struct.unpack(order + count, body)[0])
            value = struct.unpack(form, body[: struct.calcsize(form)])
            found[tag] = value[0].split(b"\0")[0].decode("utf-8", "replace") if kind == 2 else value
    one = lambda tag, other=None: found[tag][0] if tag in found else other
    bands, width, height = one(_SAMPLES, 1), one(_WIDTH), one(_HEIGHT)
    bits, sample = set(found.get(_BITS, (1,))), set(found.get(_FORMAT, (1,)))
    kind = _KINDS.get((*sample, *bits)) if len(bits) == len(sample) == 1 else None
    if kind is None or one(_COMPRESSION, 1) not in (1, 5, 8, 32946) or one(_PREDICTOR, 1) not in (1, 2, 3):
        raise ValueError(f"{path}: samples of {sorted(bits)} bits, format {sorted(sample)}, compression {one(_COMPRESSION, 1)}, predictor {one(_PREDICTOR, 1)} can't be read")
    tiled = _TILE_OFFSETS in found
    block = (one(_TILE_HEIGHT), one(_TILE_WIDTH)) if tiled else (min(one(_STRIP_ROWS, height), height), width)
    keys = dict(zip(found.get(_GEO_KEYS, ())[4::4], found.get(_GEO_KEYS, ())[7::4], strict=True))
    if _MATRIX in found:
        m = found[_MATRIX]
        transform = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif _SCALE in found and _TIE in found:
        (sx, sy), (i, j, _, x, y, _) = found[_SCALE][:2], found[_TIE][:6]
        transform = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    else:
        transform = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    if keys.get(_PIXEL_IS) == 2:  # places are those of the cells' centres
        a, b, c, d, e, g = transform
        transform = (a, b, c - (a + b) / 2, d, e, g - (d + e) / 2)
    text = found.get(_NODATA, "").strip()
    grid = Grid(width, height, tuple(map(float, transform)), keys.get(_PROJECTED, keys.get(_GEOGRAPHIC)))
    spots, sizes = (_TILE_OFFSETS, _TILE_COUNTS) if tiled else (_OFFSETS, _COUNTS)
    return Layout(grid, bands, kind, order, one(_COMPRESSION, 1), one(_PREDICTOR, 1), one(_PLANAR, 1) == 2, tiled, block, found[spots], found[sizes], float(text) if text else None, _tags(found.get(_METADATA, "")))


def _tags(xml: str) -> dict:
    """{band: {name: value}} of the metadata item list; band 0: of the file."""
    out: dict = {}
    for item in ElementTree.fromstring(xml).iter("Item") if xml.strip() else ():
        out.setdefault(int(item.get("sample", -1)) + 1, {})[item.get("name")] = item.text or ""
    return out


def unlzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; 256 clears the table and 257 ends."""
    out, bits, held, at, width = bytearray(), 0, 0, 0, 9
    table, last = [bytes([i]) for i in range(256)] + [b"", b""], b""
    while True:
        while held < width:
            if at == len(data):
                return bytes(out)
            bits, held, at = (bits & 0xFFF) << 8 | data[at], held + 8, at + 1
        held -= width
        code = bits >> held & ((1 << width) - 1)
        bits &= (1 << held) - 1
        if code == 257:
            return bytes(out)
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if not last:
            piece = table[code]
        else:
            piece = table[code] if code < len(table) else last + last[:1]
            table.append(last + piece[:1])
        out += piece
        last = piece
        # codes grow one entry early
        width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)


def block_values(layout: Layout, raw: bytes, rows: int) -> np.ndarray:
    """(rows, columns, samples) of one stored block."""
    samples, width = 1 if layout.separate else layout.bands, layout.block[1]
    data = raw if layout.compression == 1 else unlzw(raw) if layout.compression == 5 else zlib.decompress(raw)
    kind = np.dtype(layout.order + layout.kind)
    line = width * samples * kind.itemsize
    data = np.frombuffer(data, np.uint8)[: rows * line].reshape(rows, line)
    if layout.predictor == 3:
        planes = np.add.accumulate(data.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, width * samples)
        values = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">"))[..., 0]
        return values.reshape(rows, width, samples).astype(kind.newbyteorder("="))
    values = data.copy().view(kind).reshape(rows, width, samples).astype(kind.newbyteorder("="))
    if layout.predictor == 2:
        whole = values.view(f"u{kind.itemsize}")
        values = np.add.accumulate(whole, axis=1, dtype=whole.dtype).view(values.dtype)
    return values


def stored(values: np.ndarray, compression: str, predictor: int) -> bytes:
    """One block (rows, columns, samples) as it is stored, lowest byte first."""
    rows, width, samples = values.shape
    size = values.dtype.itemsize
    if predictor == 3:
        planes = values.astype(values.dtype.newbyteorder(">")).reshape(rows, width * samples, 1).view(np.uint8).transpose(0, 2, 1).reshape(rows, -1, samples)
        data = np.diff(planes, axis=1, prepend=np.zeros((rows, 1, samples), np.uint8)).tobytes()
    elif predictor == 2:
        whole = values.view(f"u{size}")
        data = np.diff(whole, axis=1, prepend=np.zeros((rows, 1, samples), whole.dtype)).astype(f"<u{size}").tobytes()
    else:
        data = values.astype(values.dtype.newbyteorder("<")).tobytes()
    return data if compression == "none" else zlib.compress(data)


@dataclass
class Block(InputPartition):
    """One block of the grid: its number, first row and column."""

    number: int
    row: int
    col: int


class RasterReader(DataSourceReader):
    """Blocks inside the window that filters on row and col leave."""

    def __init__(self, path: str, bands: list[int], empty: str):
        self.path, self.bands, self.empty, self.layout = path, bands, empty, layout_of(path)
        self.window = {"row": [0, self.layout.grid.height - 1], "col": [0, self.layout.grid.width - 1]}

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            side = self.window.get(f.attribute[0]) if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            v = getattr(f, "value", None)
            if side is None or not isinstance(v, int):
                yield f
            elif isinstance(f, EqualTo):
                side[:] = max(side[0], v), min(side[1], v)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                side[0] = max(side[0], v + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                side[1] = min(side[1], v - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> list[Block]:
        x, (tall, wide) = self.layout, self.layout.block
        (r0, r1), (c0, c1) = self.window["row"], self.window["col"]
        if r0 > r1 or c0 > c1:
            return [Block(-1, 0, 0)]
        return [Block(r * x.across + c, r * tall, c * wide) for r in range(r0 // tall, r1 // tall + 1) for c in range(c0 // wide, c1 // wide + 1)]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        x, each = self.layout, self.layout.across * self.layout.down
        if partition.number < 0:
            return
        tall = x.block[0] if x.tiled else min(x.block[0], x.grid.height - partition.row)
        store, place = opened(self.path)
        with store.open_input_file(place) as f:
            layers = {}
            for b in sorted({(n - 1) * x.separate for n in self.bands}):
                spot, size = x.offsets[b * each + partition.number], x.counts[b * each + partition.number]
                # a block that is not stored holds no data
                layers[b] = block_values(x, f.read_at(size, spot), tall) if size else np.full((tall, x.block[1], 1 if x.separate else x.bands), np.nan)
        (r0, r1), (c0, c1) = self.window["row"], self.window["col"]
        low_r, low_c = max(r0 - partition.row, 0), max(c0 - partition.col, 0)
        part = (slice(low_r, min(r1 - partition.row + 1, tall)), slice(low_c, min(c1 - partition.col + 1, x.block[1])))
        values = [layers[(n - 1) * x.separate][..., 0 if x.separate else n - 1][part].astype(np.float64) for n in self.bands]
        nothing = [np.isnan(v) | ((v == x.nodata) if x.nodata is not None else False) for v in values]
        keep = np.ones(values[0].shape, bool) if self.empty == "null" else ~np.logical_and.reduce(nothing)
        row, col = np.nonzero(keep)
        columns = [pa.array(row + (partition.row + low_r)), pa.array(col + (partition.col + low_c))]
        columns += [pa.array(v[keep], mask=n[keep]) for v, n in zip(values, nothing, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "col", *[f"b{n}" for n in self.bands]])


class RasterSource(DataSource):
    """Options: path; bands, such as 1,3 (all if not given); empty: skip (cells without any value are left out) or null."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def _bands(self) -> list[int]:
        given, n = self.options.get("bands"), layout_of(self.options["path"]).bands
        bands = [int(b) for b in given.split(",")] if given else list(range(1, n + 1))
        if not bands or min(bands) < 1 or max(bands) > n:
            raise ValueError(f"bands {bands} of {n}")
        return bands

    def schema(self) -> str:
        return "row long, col long, " + ", ".join(f"b{n} double" for n in self._bands())

    def reader(self, schema) -> RasterReader:
        return RasterReader(self.options["path"], self._bands(), self.options.get("empty", "skip"))


def read_raster(spark: SparkSession, path: str, bands: list[int] | None = None, like: Grid | str | None = None, empty: str = "skip") -> DataFrame:
    """``(row, col, b1, ...)`` of a file; nodata and NaN are null. Raises ValueError unless its grid is that of *like* (a grid or a file)."""
    if like is not None:
        wrong = layout_of(path).grid.mismatches(like if isinstance(like, Grid) else layout_of(like).grid)
        if wrong:
            raise ValueError(f"{path}: the grid differs in " + "; ".join(wrong))
    spark.dataSource.register(RasterSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("geotiff").option("empty", empty)
    return (reader.option("bands", ",".join(map(str, bands))) if bands else reader).load(path)


def read_template(spark: SparkSession, path: str) -> DataFrame:
    """Cells of the first band that hold a value; a template without any is an error."""
    cells = read_raster(spark, path, [1])
    if cells.isEmpty():
        raise ValueError(f"{path} contains no valid cells")
    return cells.select("row", "col")


def read_labels(spark: SparkSession, path: str, template: str) -> DataFrame:
    """``(row, col, label)`` on exactly the template's cells, 0 or 1; anything else is an error."""
    labels = read_raster(spark, path, [1], like=template).select("row", "col", F.col("b1").cast("int").alias("label"))
    check_masks(labels, read_template(spark, template))
    return labels


def read_support(spark: SparkSession, path: str, template: str) -> DataFrame:
    """``(row, col, p)`` of a prediction, positive cells only; values outside 0..1 are an error as they are met."""
    p = F.col("b1")
    checked = F.when(~p.between(0, 1), F.raise_error(F.lit(f"{path} has values outside 0..1")).cast("double")).otherwise(p)
    return read_raster(spark, path, [1], like=template).select("row", "col", checked.alias("p")).filter("p > 0")


def read_quantised(spark: SparkSession, path: str, band: int = 1, like: Grid | str | None = None) -> DataFrame:
    """``(row, col, value)`` of a band of one byte a cell: 0 is no data, 1 to 255 span the band's tags q_lo to q_hi (0 to 1 without them)."""
    tags = layout_of(path).tags.get(band, {})
    low, high = (float(tags[t]) for t in ("q_lo", "q_hi")) if {"q_lo", "q_hi"} <= set(tags) else (0.0, 1.0)
    q = F.col(f"b{band}")
    return read_raster(spark, path, [band], like).filter(q > 0).select("row", "col", (F.lit(low) + (q - 1) / 254 * F.lit(high - low)).alias("value"))


def read_layers(spark: SparkSession, layers: dict[str, tuple[str, int]], like: Grid | str) -> DataFrame:
    """``(row, col, names)``: one column for each layer ``{name: (path, band)}``, on every cell that one of them has; grids are checked first."""
    parts = [read_raster(spark, path, [band], like).select("row", "col", F.lit(name).alias("_n"), F.col(f"b{band}").alias("_v")) for name, (path, band) in layers.items()]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    # all layers meet in one shuffle
    return rows.groupBy("row", "col").agg(*[F.max(F.when(F.col("_n") == name, F.col("_v"))).alias(name) for name in layers])


def write_raster(
    cells: DataFrame, path: str, grid: Grid, values: list[str], kind: str = "f4", nodata: float | None = None, tile: int = 256, compression: str = "deflate", predictor: int = 1, tags: dict | None = None
) -> None:
    """Writes *values* of cells ``(row, col, ...)`` as the bands of a tiled file; cells that don't exist get *nodata* (NaN for floats).

    Tiles are packed where their cells meet and blocks without cells are not stored. The file itself is
    written by one task, which takes tiles in order as a stream. Cells outside of the grid are an error.
    """
    if compression not in ("none", "deflate") or predictor not in (1, 2, 3) or (predictor == 3) > (kind[0] == "f") or tile % 16:
        raise ValueError("compression is none or deflate, predictors are 1, 2, or for floats 3, and tiles are multiples of 16")
    across, fill = -(-grid.width // tile), (np.nan if kind[0] == "f" else 0) if nodata is None else nodata
    outside = ~(F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1))
    number = F.expr(f"row div {tile} * {across} + col div {tile}")
    placed = cells.select(F.when(outside, F.raise_error(F.lit("a cell lies outside of the grid")).cast("long")).otherwise(number).alias("_tile"), F.col("row").cast("long"), F.col("col").cast("long"), *[F.col(v).cast("double") for v in values])

    def pack(pdf):
        n = int(pdf["_tile"].iloc[0])
        block = np.full((tile, tile, len(values)), fill, kind)
        at = pdf["row"].to_numpy() - n // across * tile, pdf["col"].to_numpy() - n % across * tile
        for i, v in enumerate(values):
            block[(*at, i)] = np.nan_to_num(pdf[v].to_numpy(np.float64, na_value=np.nan), nan=fill)
        return pd.DataFrame({"tile": [n], "data": [stored(block, compression, predictor)]})

    packed = written(placed.groupBy("_tile").applyInPandas(pack, "tile long, data binary"))
    total = packed.agg(F.sum(F.length("data").cast("long"))).first()[0] or 0
    shape = dict(bands=len(values), kind=kind, nodata=None if nodata is None and kind[0] != "f" else fill, tile=tile, compression=_CODES[compression], predictor=predictor, tags=tags or {})

    def stream(batches):
        store, place = opened(path)
        blocks = across * -(-grid.height // tile)
        offsets, sizes = np.zeros(blocks, np.uint64), np.zeros(blocks, np.uint64)
        big = total + 64 * blocks > 3 << 30
        with store.open_output_stream(place) as f:
            head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16 + total) if big else struct.pack("<2sHI", b"II", 42, 8 + total)
            f.write(head)
            at = len(head)
            for batch in batches:
                for n, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    data = data.as_py()
                    f.write(data)
                    offsets[n], sizes[n] = at, len(data)
                    at += len(data)
            f.write(directory(grid, offsets, sizes, at, big, **shape))
        yield pa.RecordBatch.from_arrays([pa.array([at])], names=["bytes"])

    if not total:  # a directory alone
        list(stream(()))
        return
    packed.repartition(1).sortWithinPartitions("tile").mapInArrow(stream, "bytes long").collect()


def directory(grid: Grid, offsets: np.ndarray, sizes: np.ndarray, at: int, big: bool, bands: int, kind: str, nodata: float | None, tile: int, compression: int, predictor: int, tags: dict) -> bytes:
    """The file's directory, to stand at byte *at*."""
    a, b, c, d, e, g = grid.transform
    sample = {"u": 1, "i": 2, "f": 3}[kind[0]]
    long, place = ("Q", 16) if big else ("I", 4)
    entries = [
        (_WIDTH, 4, [grid.width]), (_HEIGHT, 4, [grid.height]), (_BITS, 3, [8 * int(kind[1])] * bands), (_COMPRESSION, 3, [compression]), (_PHOTOMETRIC, 3, [1]),
        (_SAMPLES, 3, [bands]), (_PLANAR, 3, [1]), (_PREDICTOR, 3, [predictor]), (_TILE_WIDTH, 3, [tile]), (_TILE_HEIGHT, 3, [tile]),
        (_TILE_OFFSETS, place, offsets.tolist()), (_TILE_COUNTS, place, sizes.tolist()), (_FORMAT, 3, [sample] * bands),
    ]
    if bands > 1:
        entries.append((_EXTRA, 3, [0] * (bands - 1)))
    if b == d == 0:
        entries += [(_SCALE, 12, [a, -e, 0.0]), (_TIE, 12, [0.0, 0.0, 0.0, c, g, 0.0])]
    else:
        entries.append((_MATRIX, 12, [a, b, 0.0, c, d, e, 0.0, g, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]))
    keys = [1, 1, 0, 2, _PIXEL_IS, 0, 1, 1, _PROJECTED, 0, 1, grid.epsg] if grid.epsg else [1, 1, 0, 1, _PIXEL_IS, 0, 1, 1]
    entries.append((_GEO_KEYS, 3, keys))
    if tags:
        items = "".join(f'<Item name="{n}"{f" sample=\"{band - 1}\"" if band else ""}>{v}</Item>' for band, t in tags.items() for n, v in t.items())
        entries.append((_METADATA, 2, f"<GDALMetadata>{items}</GDALMetadata>\0".encode()))
    if nodata is not None:
        entries.append((_NODATA, 2, f"{nodata:.17g}\0".encode()))
    entries.sort()
    inside, after = b"", b""
    behind = at + (8 + 20 * len(entries) + 8 if big else 2 + 12 * len(entries) + 4)
    for tag, form, values in entries:
        body = values if form == 2 else struct.pack(f"<{len(values)}{_TYPES[form]}", *values)
        inside += struct.pack("<HH" + long, tag, form, len(values))
        if len(body) <= struct.calcsize(long):
            inside += body.ljust(struct.calcsize(long), b"\0")
        else:
            inside += struct.pack("<" + long, behind + len(after))
            after += body + b"\0" * (len(body) % 2)
    return struct.pack("<Q" if big else "<H", len(entries)) + inside + struct.pack("<" + long, 0) + after
