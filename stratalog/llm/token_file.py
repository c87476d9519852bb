"""A binary file format for token ids: patched frame-of-reference blocks.

A file image holds the ids of consecutive documents. Ids are cut into blocks of 256. From each block its minimum is
subtracted; the differences are packed at the width that holds a chosen percentile of them. Differences that need more bits
go to the block's exception list, by place and value. An index gives where each block's packed bits and exceptions begin.

Layout, little endian: magic, counts (ids, documents), index (bits start, exceptions start), minimum and width of each
block, document ids with a null flag, document lengths, packed bits, exception places, exception values.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm import common
from stratalog.llm.tokens import encoder

MAGIC, BLOCK, PERCENTILE, IMAGE_IDS = b"PFOR0001", 256, 98, 1 << 18
_HEAD = struct.Struct("<8sqqqq")


def pack(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """A file image. ``lengths`` are the ids of each document, in order."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.zeros(blocks * BLOCK, np.uint32)
    full[:n] = ids
    if n < len(full):
        full[n:] = ids[-1]
    rows = full.reshape(blocks, BLOCK)
    least = rows.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rows = rows - least[:, None]
    bits = np.frexp(rows.astype(np.float64))[1]
    rank = BLOCK * int(percentile) // 100
    widths = np.partition(bits, rank, axis=1)[:, rank].astype(np.int64) if blocks else np.zeros(0, np.int64)
    odd = bits > widths[:, None]
    odd_at = np.flatnonzero(odd)
    odd_values = rows.reshape(-1)[odd_at]
    odd_starts = np.append(0, np.cumsum(odd.sum(axis=1)))
    sizes = widths * BLOCK // 8
    starts = np.append(0, np.cumsum(sizes))
    body = np.zeros(int(starts[-1]), np.uint8)
    kept = np.where(odd, 0, rows)
    for w in np.unique(widths[widths > 0]).tolist():
        chosen = np.flatnonzero(widths == w)
        spread = np.unpackbits(kept[chosen].astype("<u4").view(np.uint8).reshape(len(chosen), BLOCK, 4), axis=2, count=w, bitorder="little")
        packed = np.packbits(spread.reshape(len(chosen), -1), axis=1, bitorder="little")
        body[starts[chosen][:, None] + np.arange(w * BLOCK // 8)] = packed
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], np.int64)
    parts = [starts.astype("<i8"), odd_starts.astype("<i8"), least.astype("<u4"), widths.astype(np.uint8), names.astype("<i8"), nulls, np.asarray(lengths).astype("<i8"), body, (odd_at % BLOCK).astype(np.uint8), odd_values.astype("<u4")]
    return _HEAD.pack(MAGIC, n, len(doc_ids), blocks, len(odd_at)) + b"".join(p.tobytes() for p in parts)


def unpack(image: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """The ids, document ids and lengths of a file image."""
    magic, n, docs, blocks, odd = _HEAD.unpack_from(image)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = _HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(image, kind, count, at)
        at += out.nbytes
        return out

    starts, odd_starts = take("<i8", blocks + 1), take("<i8", blocks + 1)
    least, widths = take("<u4", blocks), take("u1", blocks).astype(np.int64)
    names, nulls, lengths = take("<i8", docs), take("u1", docs), take("<i8", docs)
    body, places, values = take("u1", int(starts[-1])), take("u1", odd), take("<u4", odd)
    rows = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(widths[widths > 0]).tolist():
        chosen = np.flatnonzero(widths == w)
        packed = body[starts[chosen][:, None] + np.arange(w * BLOCK // 8)]
        spread = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(chosen), BLOCK, w)
        rows[chosen] = spread.astype(np.uint32) @ (np.uint32(1) << np.arange(w, dtype=np.uint32))
    rows[np.repeat(np.arange(blocks), np.diff(odd_starts)), places] = values
    ids = (rows + least[:, None]).reshape(-1)[:n]
    return ids, [None if z else int(x) for x, z in zip(names, nulls, strict=True)], lengths


def block_ids(image: bytes, block: int) -> np.ndarray:
    """One block's ids, found through the index without unpacking the rest."""
    _, n, docs, blocks, odd = _HEAD.unpack_from(image)
    at = _HEAD.size
    start, end = np.frombuffer(image, "<i8", 2, at + 8 * block)
    first, last = np.frombuffer(image, "<i8", 2, at + 8 * (blocks + 1) + 8 * block)
    at += 16 * (blocks + 1)
    least = int(np.frombuffer(image, "<u4", 1, at + 4 * block)[0])
    at += 4 * blocks
    w = image[at + block]
    at += blocks + 17 * docs
    total = int(np.frombuffer(image, "<i8", 1, _HEAD.size + 8 * blocks)[0])
    out = np.zeros(BLOCK, np.uint32)
    if w:
        out += np.unpackbits(np.frombuffer(image, "u1", end - start, at + start), bitorder="little").reshape(BLOCK, w).astype(np.uint32) @ (np.uint32(1) << np.arange(w, dtype=np.uint32))
    places = np.frombuffer(image, "u1", last - first, at + total + first)
    out[places] = np.frombuffer(image, "<u4", last - first, at + total + odd + 4 * first)
    return (out + least)[: n - block * BLOCK]


def write_token_files(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", image_ids: int = IMAGE_IDS) -> DataFrame:
    """File images in ascending id order: (part, number, first, n_ids, n_docs, image), written to the shared folder.

    Each range of ids is a part; ``first`` counts the ids before an image in its part. A document's ids stay in one image,
    which holds about ``image_ids`` ids or one longer document. Null text counts as empty; null ids come first. Rows of one
    id, or of null ids, are ordered by a hash of their texts, so that many of them are dealt to several ranges too. An empty
    table gives no image.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(common.partitions(spark), "id", "h").sortWithinPartitions("id", "h").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, first = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        lengths: list[np.ndarray] = []
        held: list[np.ndarray] = []

        def image() -> pa.RecordBatch:
            nonlocal number, first
            ids, sizes = np.concatenate(held), np.concatenate(lengths)
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "first": [first], "n_ids": [len(ids)], "n_docs": [len(names)], "image": [pack(ids, names, sizes)]})
            number, first = number + 1, first + len(ids)
            names.clear(), lengths.clear(), held.clear()
            return row

        for piece in common.pieces(batches, "text", 3 << 20):
            ids, bounds = encoder(tokenizer).encode(piece.column("text"))
            names += piece.column("id").to_pylist()
            lengths.append(np.diff(bounds))
            held.append(ids)
            if sum(map(len, held)) >= image_ids:
                yield image()
        if names:
            yield image()

    images = rows.mapInArrow(run, "part int, number int, first long, n_ids long, n_docs long, image binary")
    return common.written(images, "tokens")


def read_token_files(images: DataFrame) -> DataFrame:
    """Documents of written images: doc_id, start (ids of all documents before), n_tokens, ids_crc32, image_part, image_number."""
    spark = images.sparkSession
    # One row for each part: as many as the shuffle has partitions.
    totals = sorted((r["part"], r["n"]) for r in images.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, total = [], 0
    for part, n in totals:
        before.append((part, total))
        total += n
    bases = spark.createDataFrame(before, "part int, base long")
    rows = images.join(F.broadcast(bases), "part")
    common.small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {name: batch.column(name)[row].as_py() for name in ("part", "number", "base", "first", "image")}
                ids, names, lengths = unpack(one["image"])
                ends = np.cumsum(lengths)
                data, starts = ids.astype("<u4"), ends - lengths
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(names, pa.int64()), "start": pa.array(starts + one["base"] + one["first"], pa.int64()), "n_tokens": pa.array(lengths, pa.int64()),
                    "ids_crc32": pa.array([common.crc(data[a:b]) for a, b in zip(starts, ends, strict=True)], pa.int64()),
                    "image_part": pa.array([one["part"]] * len(names), pa.int32()), "image_number": pa.array([one["number"]] * len(names), pa.int32()),
                })

    return rows.select("part", "number", "base", "first", "image").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, image_part int, image_number int")
