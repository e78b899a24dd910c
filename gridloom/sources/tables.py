"""Rasters from tables, tiles and binary files; headers; fixtures."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.nodes import Load


def from_keys(table: DataFrame, key: str, width: int, bands: dict[str, Column | str], name: str = "", size=None) -> Load:
    """A raster from a table with dense keys 0..n-1, ``width`` pixels a row. Only the bands' columns are read."""
    cols = [(F.col(c) if isinstance(c, str) else c).alias(b) for b, c in bands.items()]

    def pixels(rows: DataFrame) -> DataFrame:
        return rows.select(F.expr(f"{key} div {width}").alias("y"), F.expr(f"{key} % {width}").cast("bigint").alias("x"), *cols)

    def rows_of(y0: int, y1: int) -> DataFrame:
        return pixels(table.where((F.col(key) >= y0 * width) & (F.col(key) < y1 * width)))

    if size is None:
        last = table.agg(F.max(key)).first()[0]
        size = (width, 0 if last is None else int(last) // width + 1)
    return Load(pixels(table), tuple(bands), size, name=name, rows_of=rows_of)


def from_array(spark: SparkSession, data, channels=None) -> Load:
    """A raster of an array in memory: (height, width) or (height, width, bands). Masked values become NULL."""
    mask = np.ma.getmaskarray(data)
    data = np.asarray(data)
    data, mask = (data[..., None], mask[..., None]) if data.ndim == 2 else (data, mask)
    h, w, n = data.shape
    names = tuple(channels) if channels else tuple(f"c{i}" for i in range(n))
    y, x = np.mgrid[:h, :w]
    wider = {"uint8": "int16", "uint16": "int32", "uint32": "int64", "uint64": "float64", "float16": "float32", "bool": "bool"}
    data = data.astype(wider.get(str(data.dtype), str(data.dtype)))
    cols = [pa.array(data[..., i].ravel(), mask=mask[..., i].ravel()) for i in range(n)]
    rows = pa.table([pa.array(y.ravel().astype("int64")), pa.array(x.ravel().astype("int64")), *cols], names=["y", "x", *names])
    return Load(spark.createDataFrame(rows), names, (w, h), name="array")


TILES = "image_id string, level int, y0 bigint, x0 bigint, h int, w int, bands array<string>, dtype string, data binary"


def to_tiles(raster: Load, image_id: str, tile: int = 256, dtype: str = "float64") -> DataFrame:
    """Square tiles of packed numbers, all bands together: one row a tile, for dense storage."""
    bands, (width, height) = list(raster.channels), raster.dsize

    def pack(key, rows: pa.Table) -> pa.Table:
        y0, x0 = (int(k.as_py()) * tile for k in key)
        y, x = rows.column("y").to_numpy() - y0, rows.column("x").to_numpy() - x0
        data = np.full((tile, tile, len(bands)), np.nan)
        for i, b in enumerate(bands):
            data[y, x, i] = rows.column(b).to_numpy(zero_copy_only=False).astype(float)
        h, w = min(tile, height - y0), min(tile, width - x0)
        values = [image_id, 0, y0, x0, h, w, bands, dtype, data[:h, :w].astype(dtype).tobytes()]
        types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.binary()]
        names = [c.split()[0] for c in TILES.split(", ")]
        return pa.table([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

    frame = raster.frame.select("y", "x", *[F.col(f"`{b}`").cast("double").alias(b) for b in bands])
    keyed = frame.groupBy((F.col("y") / tile).cast("bigint").alias("ty"), (F.col("x") / tile).cast("bigint").alias("tx"))
    return keyed.applyInArrow(lambda key, rows: pack(key, rows), TILES)


def from_tiles(tiles: DataFrame, bands: list[str], size: tuple[int, int], window=None, level: int = 0) -> Load:
    """The pixels of a window (x0, y0, x1, y1) of a tile table; tiles outside it aren't read or unpacked."""
    tiles = tiles.where(F.col("level") == level)
    if window:
        x0, y0, x1, y1 = window
        tiles = tiles.where(f"x0 < {x1} and x0 + w > {x0} and y0 < {y1} and y0 + h > {y0}")

    def unpack(batches):
        for batch in batches:
            for t in batch.to_pylist():
                data = np.frombuffer(t["data"], t["dtype"]).reshape(t["h"], t["w"], -1)
                y, x = np.mgrid[t["y0"] : t["y0"] + t["h"], t["x0"] : t["x0"] + t["w"]]
                cols = [pa.array(data[..., t["bands"].index(b)].ravel().astype(float)) for b in bands]
                yield pa.RecordBatch.from_arrays([pa.array(y.ravel()), pa.array(x.ravel()), *cols], ["y", "x", *bands])

    frame = tiles.mapInArrow(unpack, "y bigint, x bigint, " + ", ".join(f"`{b}` double" for b in bands))
    if window:
        frame = frame.where(f"y >= {y0} and y < {y1} and x >= {x0} and x < {x1}")
    return Load(frame, tuple(bands), size, name="tiles")


def with_pyramid(raster: Load, levels: int) -> Load:
    """A raster with stored levels by averaging two by two, each made from the one before."""
    from dataclasses import replace

    frames, below = [], raster.frame
    for _ in range(levels):
        cell = [F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x")]
        below = below.groupBy(*cell).agg(*[F.avg(f"`{b}`").alias(b) for b in raster.channels])
        frames.append(below)
    return replace(raster, levels=tuple(frames))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, y, x, b, g, r) of PNG and JPEG files, by Spark's own image reader."""

    def unpack(batches):
        for batch in batches:
            for t in batch.to_pylist():
                data = np.frombuffer(t["data"], np.uint8).reshape(t["height"], t["width"], -1)
                y, x = np.mgrid[: t["height"], : t["width"]]
                bands = [data[..., min(i, data.shape[2] - 1)].ravel().astype("int16") for i in range(3)]
                cols = [pa.array([t["origin"]] * y.size), pa.array(y.ravel()), pa.array(x.ravel()), *map(pa.array, bands)]
                yield pa.RecordBatch.from_arrays(cols, ["image_id", "y", "x", "b", "g", "r"])

    images = spark.read.format("image").load(path).select("image.*")
    return images.select("origin", "height", "width", "data").mapInArrow(unpack, "image_id string, y bigint, x bigint, b smallint, g smallint, r smallint")


#: ENVI data type numbers and NumPy types (fixed values).
ENVI_TYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 6: "c8", 9: "c16", 12: "u2", 13: "u4", 14: "i8", 15: "u8"}


def parse_envi_header(text: str) -> dict:
    """Fields of an ENVI header by lower-case key; braces hold lists over lines, semicolons start comments."""
    lines = [line for line in text.splitlines() if not line.lstrip().startswith(";")]
    if not lines or lines[0].strip() != "ENVI":
        raise ValueError("not an ENVI header")
    out, key, held = {}, "", None
    for line in lines[1:]:
        if held is None:
            key, equals, value = (s.strip() for s in line.partition("="))
            if not equals:
                continue
            key = key.lower()
            if not value.startswith("{"):
                out[key] = value
                continue
            held = ""
            line = value
        held += line.strip() + " "
        if line.rstrip().endswith("}"):
            out[key] = [v.strip() for v in held.strip()[1:-1].split(",")]
            held = None
    return out


def read_envi(spark: SparkSession, header_path: str, data_path: str, bands: list[str] | None = None) -> Load:
    """An ENVI raster; header and data are read by Spark, so both may be in any store it reads."""
    head = parse_envi_header("\n".join(r[0] for r in spark.read.text(header_path, wholetext=True).collect()))
    w, h, n = int(head["samples"]), int(head["lines"]), int(head["bands"])
    kind = (">" if head.get("byte order", "0") == "1" else "<") + ENVI_TYPES[int(head["data type"])]
    order, skip = head.get("interleave", "bsq").lower(), int(head.get("header offset", "0"))
    names = head.get("band names") or [f"c{i}" for i in range(n)]
    chosen = bands or names

    def unpack(batches):
        for batch in batches:
            for t in batch.to_pylist():
                data = np.frombuffer(t["content"], kind, offset=skip)
                data = {"bsq": lambda d: d.reshape(n, h, w).transpose(1, 2, 0), "bil": lambda d: d.reshape(h, n, w).transpose(0, 2, 1), "bip": lambda d: d.reshape(h, w, n)}[order](data)
                y, x = np.mgrid[:h, :w]
                cols = [pa.array(data[..., names.index(b)].ravel().astype(float)) for b in chosen]
                yield pa.RecordBatch.from_arrays([pa.array(y.ravel()), pa.array(x.ravel()), *cols], ["y", "x", *chosen])

    files = spark.read.format("binaryFile").load(data_path).select("content")
    frame = files.mapInArrow(unpack, "y bigint, x bigint, " + ", ".join(f"`{b}` double" for b in chosen))
    return Load(frame, tuple(chosen), (w, h), name=data_path)


def nonzero(raster: Load) -> bool:
    """Whether any pixel of any band is neither zero nor missing; stops at the first."""
    some = functools.reduce(lambda a, b: a | b, [(F.col(f"`{b}`") != 0) & ~F.isnan(F.col(f"`{b}`").cast("double")) for b in raster.channels])
    return not raster.frame.where(some).limit(1).isEmpty()


def demo(spark: SparkSession, size: tuple[int, int] = (64, 48), bands=("r", "g", "b"), levels: int = 0) -> Load:
    """A synthetic raster of whole numbers 0..255."""
    w, h = size
    frame = spark.range(w * h).selectExpr(f"id div {w} as y", f"id % {w} as x", *[f"cast((id * {7 + 6 * i} + {31 * i}) % 256 as smallint) as {b}" for i, b in enumerate(bands)])
    raster = Load(frame, tuple(bands), size, name="demo")
    return with_pyramid(raster, levels) if levels else raster


