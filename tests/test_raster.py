"""GeoTIFF files: written here and read back, and files of other writers' layouts."""

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrastrat.sources import raster

GRID = raster.Grid(70, 50, (100.0, 0.0, 500.0, 0.0, -100.0, 9000.0), 32611)


def cells_of(spark, seed=1, share=0.6, shape=(50, 70)):
    rng = np.random.default_rng(seed)
    r, c = np.nonzero(rng.random(shape) < share)
    a, b = rng.normal(size=len(r)), rng.integers(0, 200, len(r))
    return spark.createDataFrame([(int(i), int(j), float(x), int(y)) for i, j, x, y in zip(r, c, a, b, strict=True)], "row long, col long, a double, b long")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(("kind", "compression", "predictor"), [("f8", "none", 1), ("f8", "deflate", 3), ("f8", "deflate", 2), ("f8", "none", 3)])
def test_what_is_written_is_read(spark, tmp_path, kind, compression, predictor):
    path, df = f"{tmp_path}/a.tif", cells_of(spark)
    raster.write_raster(df, path, GRID, ["a", "b"], kind, tile=32, compression=compression, predictor=predictor)
    assert raster.layout_of(path).grid == GRID
    assert rows(raster.read_raster(spark, path)) == rows(df.select("row", "col", "a", F.col("b").cast("double")))
    assert rows(raster.read_raster(spark, "file://" + path, [2])) == rows(df.select("row", "col", F.col("b").cast("double")))


def test_a_window_reads_fewer_blocks(spark, tmp_path):
    path, df = f"{tmp_path}/a.tif", cells_of(spark)
    raster.write_raster(df, path, GRID, ["a"], "f8", tile=16)
    whole, part = raster.read_raster(spark, path), raster.read_raster(spark, path).filter("row > 15 AND row <= 31 AND col = 40")
    assert rows(part) == rows(df.filter("row > 15 AND row <= 31 AND col = 40").select("row", "col", "a"))
    assert (whole.rdd.getNumPartitions(), part.rdd.getNumPartitions()) == (20, 1)
    other = raster.read_raster(spark, path).filter("row IN (1, 49) AND b1 > 0")
    assert rows(other) == rows(df.filter("row IN (1, 49) AND a > 0").select("row", "col", "a"))
    assert raster.read_raster(spark, path).filter("row > 100").count() == 0


def test_empty_blocks_are_not_stored(spark, tmp_path):
    path = f"{tmp_path}/a.tif"
    raster.write_raster(spark.createDataFrame([(49, 69, 2.5)], "row long, col long, v double"), path, GRID, ["v"], tile=16)
    assert sum(n > 0 for n in raster.layout_of(path).counts) == 1
    assert rows(raster.read_raster(spark, path)) == [(49, 69, 2.5)]
    assert raster.read_raster(spark, path, empty="null").count() == 50 * 70


def strips(values: np.ndarray, order: str, strip: int, pack, extra=()) -> bytes:
    """A file of strips with the directory in front, written by another route than the library's."""
    kind = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    parts = [pack(values[i : i + strip].astype(values.dtype.newbyteorder(order)).tobytes()) for i in range(0, len(values), strip)]
    n = len(parts)
    entries = [(256, 4, [values.shape[1]]), (257, 4, [values.shape[0]]), (258, 3, [8 * values.dtype.itemsize]), (262, 3, [1]), (273, 4, [0] * n), (277, 3, [1]), (278, 4, [strip]), (279, 4, [len(p) for p in parts]), (339, 3, [kind]), *extra]
    entries.sort()
    base = 8 + 2 + 12 * len(entries) + 4
    tables = {273: base, 279: base + 4 * n}
    at = base + 8 * n
    extra_at = {}
    blob = b""
    for tag, form, v in entries:
        size = {2: 1, 3: 2, 4: 4, 12: 8}[form] * len(v)
        if tag not in tables and size > 4:
            extra_at[tag] = at + len(blob)
            blob += bytes(v) if form == 2 else struct.pack(f"{order}{len(v)}{ {3: 'H', 4: 'I', 12: 'd'}[form] }".replace(" ", ""), *v)
    data_at = at + len(blob)
    spots = [data_at + sum(map(len, parts[:i])) for i in range(n)]
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", len(entries))
    for tag, form, v in entries:
        v = spots if tag == 273 else v
        head += struct.pack(order + "HHI", tag, form, len(v))
        if tag in tables and n > 1:
            head += struct.pack(order + "I", tables[tag])
        elif tag in extra_at:
            head += struct.pack(order + "I", extra_at[tag])
        else:
            head += (bytes(v) if form == 2 else struct.pack(f"{order}{len(v)}{'H' if form == 3 else 'I'}", *v)).ljust(4, b"\0")
    head += struct.pack(order + "I", 0)
    return head + struct.pack(f"{order}{n}I", *spots) + struct.pack(f"{order}{n}I", *map(len, parts)) + blob + b"".join(parts)


def lzw(data: bytes) -> bytes:
    """The classical encoder: a clear code first, codes that widen when the table has 511, 1023 and 2047 entries."""
    out, table, width = [(256, 9)], {bytes([i]): i for i in range(256)}, 9
    size, held = 258, b""
    for byte in data:
        new = held + bytes([byte])
        if new in table:
            held = new
            continue
        out.append((table[held], width))
        table[new] = size
        size += 1
        width = 9 + (size > 511) + (size > 1023) + (size > 2047)
        if size == 4094:
            out.append((256, width))
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        held = bytes([byte])
    if held:
        out.append((table[held], width))
        size += 1
        width = 9 + (size > 511) + (size > 1023) + (size > 2047)
    out.append((257, width))
    bits = "".join(f"{c:0{w}b}" for c, w in out)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(min_size=1, max_size=40), st.integers(1, 200)), max_size=12))
def test_lzw_codes(parts):
    data = b"".join(p * n for p, n in parts)
    assert raster.unlzw(lzw(data)) == data


def test_long_random_lzw():
    data = np.random.default_rng(3).integers(0, 12, 60_000, dtype=np.uint8).tobytes()
    assert raster.unlzw(lzw(data)) == data


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize(("code", "pack"), [(1, bytes), (5, lzw), (8, zlib.compress)])
def test_strips_of_either_byte_order(spark, tmp_path, order, code, pack):
    values = np.random.default_rng(5).integers(-5, 900, (23, 17)).astype("i2")
    path = f"{tmp_path}/s.tif"
    extra = [(259, 3, [code]), (33550, 12, [2.0, 3.0, 0.0]), (33922, 12, [0, 0, 0, 10.0, 20.0, 0]), (42113, 2, b"-5\0"), (34735, 3, [1, 1, 0, 2, 1025, 0, 1, 2, 3072, 0, 1, 3857])]
    open(path, "wb").write(strips(values, order, 4, pack, extra))
    layout = raster.layout_of(path)
    assert layout.grid == raster.Grid(17, 23, (2.0, 0.0, 9.0, 0.0, -3.0, 21.5), 3857) and layout.nodata == -5
    got = rows(raster.read_raster(spark, path))
    assert got == [(r, c, float(v)) for (r, c), v in np.ndenumerate(values) if v != -5]


def test_floating_predictor_of_lzw_tiles(spark, tmp_path, monkeypatch):
    """The usual form of a submission: 32-bit floats in tiles, floating predictor, LZW."""
    path, df = f"{tmp_path}/a.tif", cells_of(spark)
    raster.write_raster(df, path, GRID, ["a"], "f4", tile=32, predictor=3)
    layout = raster.layout_of(path)
    raw = open(path, "rb").read()
    for spot, size in zip(layout.offsets, layout.counts, strict=True):
        block = raw[spot : spot + size]
        plain = raster.block_values(layout, block, 32)
        coded = raster.block_values(raster.Layout(**{**layout.__dict__, "compression": 5}), lzw(zlib.decompress(block)), 32)
        assert np.array_equal(plain, coded, equal_nan=True)
    want = rows(df.select("row", "col", F.col("a").cast("float").cast("double")))
    assert rows(raster.read_raster(spark, path)) == want


def test_wrong_grids_and_files_raise(spark, tmp_path):
    path, other = f"{tmp_path}/a.tif", f"{tmp_path}/b.tif"
    df = cells_of(spark)
    raster.write_raster(df, path, GRID, ["b"], "u1", nodata=255)
    raster.write_raster(df, other, raster.Grid(70, 50, (100.0, 0.0, 600.0, 0.0, -100.0, 9000.0), 32612), ["b"], "u1", nodata=255)
    with pytest.raises(ValueError, match="epsg.*transform"):
        raster.read_raster(spark, path, like=other)
    with pytest.raises(Exception, match="bands"):
        raster.read_raster(spark, path, [2]).count()
    open(f"{tmp_path}/c.tif", "wb").write(b"no raster at all")
    with pytest.raises(ValueError, match="not a TIFF"):
        raster.layout_of(f"{tmp_path}/c.tif")
    with pytest.raises(Exception, match="outside of the grid"):
        raster.write_raster(spark.createDataFrame([(50, 0, 1.0)], "row long, col long, v double"), path, GRID, ["v"])


def test_labels_and_supports_are_checked(spark, tmp_path):
    t, good, bad, p = (f"{tmp_path}/{n}.tif" for n in "tgbp")
    df = cells_of(spark).withColumn("label", (F.col("b") % 2).cast("int"))
    raster.write_raster(df, t, GRID, ["a"])
    raster.write_raster(df, good, GRID, ["label"], "u1", nodata=255)
    raster.write_raster(df.filter("row < 40"), bad, GRID, ["label"], "u1", nodata=255)
    assert raster.read_labels(spark, good, t).filter("label = 1").count() == df.filter("label = 1").count()
    with pytest.raises(ValueError, match="one mask only"):
        raster.read_labels(spark, bad, t)
    raster.write_raster(df, p, GRID, ["a"])
    with pytest.raises(Exception, match="outside 0..1"):
        raster.read_support(spark, p, t).count()
    with pytest.raises(ValueError, match="no valid"):
        raster.write_raster(df.filter("false"), bad, GRID, ["a"])
        raster.read_template(spark, bad)
