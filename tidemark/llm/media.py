"""Media columns: payloads stored losslessly as progressive JPEG, decoded to full-resolution RGB tensors.

The format's unit is the quantised coefficient. A payload byte less 128 is one coefficient (quantiser 1) of a 4:2:0
image 16 pixels wide, so what the scans accumulate to gives the payload back, while the inverse transform and chroma
upsampling give the picture. A long payload becomes several images in one stream, which bounds what is decoded at once.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType

from tidemark.llm import progressive_jpeg as jpeg

UNIT = 576
FRAME = 512 * UNIT
AT_ONCE = 2 << 20
MCU = 64 * jpeg.MCU_BLOCKS


def payload(text: str | None) -> bytes:
    """UTF-8, filled up with bytes 255 to a positive multiple of UNIT."""
    data = (text or "").encode()
    return data + b"\xff" * (UNIT if not data else -len(data) % UNIT)


def groups(sizes: list[int]) -> Iterator[slice]:
    """Runs of items whose sizes sum to about AT_ONCE."""
    low, total = 0, 0
    for n, size in enumerate(sizes):
        if total and total + size > AT_ONCE:
            yield slice(low, n)
            low, total = n, 0
        total += size
    if low < len(sizes):
        yield slice(low, len(sizes))


def to_media(data: list[bytes]) -> list[bytes]:
    """Each payload as a stream of images, whose comments hold the bytes that they store."""
    parts = [(n, d[at : at + FRAME]) for n, d in enumerate(data) for at in range(0, len(d), FRAME)]
    mcus = np.array([-(-len(p) // MCU) for _, p in parts])
    first = np.cumsum(mcus) - mcus
    values = np.zeros(int(mcus.sum()) * MCU, dtype=np.int16)
    for (_, part), at in zip(parts, (first * MCU).tolist()):
        values[at : at + len(part)] = np.frombuffer(part, dtype=np.uint8).astype(np.int16) - 128
    out = [b""] * len(data)
    for own in groups([len(p) for _, p in parts]):
        begin, end = int(first[own.start]), int(first[own.stop - 1] + mcus[own.stop - 1])
        images = jpeg.encode(values[begin * MCU : end * MCU].reshape(-1, jpeg.MCU_BLOCKS, 64), mcus[own], [b"payload %d" % len(p) for _, p in parts[own]])
        for (n, _), image in zip(parts[own], images):
            out[n] += image
    return out


def from_media(streams: list[bytes], rgb: bool) -> list[tuple[bytes, int, int, bytes | None, str]]:
    """(payload, width, height, RGB tensor, feature) of each stream; the images of a stream stand below one another."""
    out: list[list] = [[[], 0, 0, [], np.zeros(3, np.int64), 0] for _ in streams]
    images = [(n, i) for n, s in enumerate(streams) for i in jpeg.parse(s)]
    for own in groups([MCU * i.grid[0] * i.grid[1] for _, i in images]):
        batch = images[own]
        coefficients = jpeg.decode_coefficients([i for _, i in batch])
        tensors = jpeg.to_rgb([i for _, i in batch], coefficients)
        for (n, image), parts, tensor in zip(batch, coefficients, tensors):
            row = out[n]
            if image.comment.startswith(b"payload "):
                values = np.concatenate([p.reshape(len(parts[-1]), -1) for p in parts], axis=1)
                row[0].append((values.ravel()[: int(image.comment[8:])] + 128).astype(np.uint8).tobytes())
            row[1], row[2] = image.width, row[2] + image.height
            if rgb:
                row[3].append(tensor.tobytes())
            row[4] += tensor.sum(axis=(0, 1), dtype=np.int64)
            row[5] += 1
    done = []
    for parts, width, height, pixels, sums, count in out:
        mean = sums / max(1, width * height)
        feature = f"images={count} size={width}x{height} mean_rgb={mean[0]:.3f},{mean[1]:.3f},{mean[2]:.3f}"
        done.append((b"".join(parts), width, height, b"".join(pixels) if rgb else None, feature))
    return done


def decoded(streams: list[tuple[int, bytes]], rgb: bool) -> list[tuple[int, tuple]]:
    """from_media() of numbered streams; if one of them is broken, each alone, without those that are."""
    try:
        return list(zip([n for n, _ in streams], from_media([s for _, s in streams], rgb)))
    except (ValueError, IndexError, KeyError, OverflowError, struct.error):
        return [x for one in streams for x in decoded([one], rgb)] if len(streams) > 1 else []


def add_media(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace the text column by n_bytes (its UTF-8 bytes) and media, the JPEG stream that stores its payload.

    Null texts count as empty. Equal texts have equal media. Rows and other columns stay, columns with these names go.
    """
    kept = [c for c in df.columns if c not in (text_col, "n_bytes", "media")]
    schema = df.select(*kept).schema.add("n_bytes", LongType()).add("media", BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text_col)), 0).to_pylist()
            for own in groups(sizes):
                part = batch.slice(own.start, own.stop - own.start)
                media = to_media([payload(t.as_py()) for t in part.column(text_col)])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(sizes[own], pa.int64()), pa.array(media, pa.binary())], names=[*kept, "n_bytes", "media"])

    return df.select(*kept, text_col).mapInArrow(run, schema)


def read_media(df: DataFrame, rgb: bool = True) -> DataFrame:
    """Add payload, width, height, rgb and feature, decoded from the column media (progressive JPEG streams).

    rgb is the height x width x 3 tensor's bytes, left out on request; payload is null for pictures that hold none, and
    all five are null for null media and for streams that can't be decoded. Columns with these names are replaced.
    """
    names = ["payload", "width", "height", *["rgb"] * rgb, "feature"]
    kept = [c for c in df.columns if c not in names]
    schema = df.select(*kept).schema
    for name, kind in zip(names, (BinaryType(), IntegerType(), IntegerType(), *[BinaryType()] * rgb, StringType())):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.binary(), pa.int32(), pa.int32(), *[pa.binary()] * rgb, pa.string()]
        for batch in batches:
            for own in groups(pa.compute.fill_null(pa.compute.binary_length(batch.column("media")), 0).to_pylist()):
                part = batch.slice(own.start, own.stop - own.start)
                found: list = [None] * part.num_rows
                there = [n for n, m in enumerate(part.column("media")) if m.is_valid]
                for n, (data, width, height, pixels, feature) in decoded([(n, part.column("media")[n].as_py()) for n in there], rgb):
                    found[n] = (data or None, width, height, *[pixels] * rgb, feature)
                columns = zip(*(f or (None,) * len(names) for f in found))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[*kept, *names])

    return df.select(*kept).mapInArrow(run, schema)


def op4_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    read = read_media(add_media(docs))
    return read.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.expr("crc32(substring(payload, -32))").alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
        "width", "height", F.sha2("rgb", 256).alias("rgb_sha256"),
    )
