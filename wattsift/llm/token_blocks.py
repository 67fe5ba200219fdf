"""Token ids in patched frame-of-reference blocks.

A segment is a self-contained byte string: a header, an index of block starts,
and blocks of 128 ids.  A block keeps its minimum, the differences to it packed
at the width that holds nine tenths of them, and an exception list (position,
difference) for the others.  All numbers are little-endian:

    magic "PFR1" | ids u4 | blocks u4
    minimum u4 x blocks | width u1 x blocks | exceptions u1 x blocks | start u4 x (blocks + 1)
    per block: packed differences (16 * width bytes, low bits first), positions u1, differences u4

The index makes any range of ids readable without the blocks before it.

Files are written in ascending doc_id order: documents are dealt out by range,
each task writes the segments of its range, whole documents each, and a file
holds (shard, segment, ids of its documents, their lengths, payload).  The
container is Parquet, so Spark's committer handles lost tasks and any store that
Spark writes to will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import documents, materialize, slices
from .tokens import WORD_BPE, encoder, vocabulary

MAGIC, BLOCK, PERCENTILE = b"PFR1", 128, 0.9
#: Ids after which a segment ends with the document at hand.
SEGMENT_IDS = 1 << 18
END_ID = 1

_SEGMENTS = "shard int, segment int, n_ids long, doc_ids array<long>, doc_lengths array<long>, payload binary"


def _ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes laid end to end: each place's group, and its place in the group."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def encode_segment(ids: np.ndarray) -> bytes:
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[:n] = ids
    padded[n:] = ids[-1] if n else 0
    rows = padded.reshape(blocks, BLOCK)
    low = rows.min(axis=1) if blocks else np.zeros(0, np.uint32)
    diff = rows - low[:, None]
    common = np.partition(diff, int(BLOCK * PERCENTILE), axis=1)[:, int(BLOCK * PERCENTILE)] if blocks else low
    width = np.ceil(np.log2(common.astype(np.float64) + 1)).astype(np.uint8)
    outside = diff >> np.minimum(width, 31)[:, None] > 0
    outside[width > 31] = False
    count = outside.sum(axis=1)
    size = 16 * width.astype(np.int64) + 5 * count
    start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    data = np.zeros(start[-1], np.uint8)
    inside = np.where(outside, 0, diff)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        bits = ((inside[own][:, :, None] >> np.arange(w, dtype=np.uint32)) & 1).astype(np.uint8)
        data[start[own][:, None] + np.arange(16 * w)] = np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little")
    b, at = np.nonzero(outside)
    k = np.arange(len(b)) - (np.cumsum(count) - count)[b]
    base = start[b] + 16 * width[b].astype(np.int64)
    data[base + k] = at
    data[(base + count[b] + 4 * k)[:, None] + np.arange(4)] = diff[b, at].astype("<u4").view(np.uint8).reshape(-1, 4)
    head = MAGIC + np.array([n, blocks], "<u4").tobytes()
    return head + low.astype("<u4").tobytes() + width.tobytes() + count.astype(np.uint8).tobytes() + start.astype("<u4").tobytes() + data.tobytes()


def read_range(payload: bytes | memoryview, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids [start, stop) of a segment, from the blocks that hold them."""
    view = memoryview(payload)
    if bytes(view[:4]) != MAGIC:
        raise ValueError("not a segment of token blocks")
    n, blocks = np.frombuffer(view, "<u4", 2, 4).tolist()
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint32)
    at = 12
    low = np.frombuffer(view, "<u4", blocks, at)
    width = np.frombuffer(view, np.uint8, blocks, at + 4 * blocks)
    count = np.frombuffer(view, np.uint8, blocks, at + 5 * blocks).astype(np.int64)
    begin = np.frombuffer(view, "<u4", blocks + 1, at + 6 * blocks).astype(np.int64)
    data = np.frombuffer(view, np.uint8, -1, at + 6 * blocks + 4 * (blocks + 1))
    first, last = start // BLOCK, -(-stop // BLOCK)
    low, width, count, begin = low[first:last], width[first:last].astype(np.int64), count[first:last], begin[first:last]
    rows = np.zeros((last - first, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        bits = np.unpackbits(data[begin[own][:, None] + np.arange(16 * w)], axis=1, bitorder="little").reshape(len(own), BLOCK, w)
        for bit in range(w):
            rows[own] |= bits[:, :, bit].astype(np.uint32) << np.uint32(bit)
    b, k = _ragged(count)
    base = begin[b] + 16 * width[b]
    rows[b, data[base + k]] = np.ascontiguousarray(data[(base + count[b] + 4 * k)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
    rows += low[:, None]
    return rows.reshape(-1)[start - first * BLOCK : stop - first * BLOCK]


def _write_segments(path: str, byte_level: bool, end_id: int, segment_ids: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = TaskContext.get().partitionId(), 0
        own, parts, size = [], [], 0

        def segment() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "segment": pa.array([number], pa.int32()), "n_ids": [len(ids)],
                "doc_ids": pa.array([own], pa.list_(pa.int64())), "doc_lengths": pa.array([[len(p) // 4 for p in parts]], pa.list_(pa.int64())),
                "payload": pa.array([encode_segment(ids)], pa.binary()),
            })

        for b in slices(batches):
            for doc, ids in zip(b.column("doc_id").to_pylist(), encoder(path, byte_level).encode(b.column("text").to_pylist())):
                own.append(doc)
                parts.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= segment_ids:
                    yield segment()
                    own, parts, size, number = [], [], 0, number + 1
        if own:
            yield segment()

    return run


def _read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            ids = read_range(b.column("payload")[i].as_buffer())
            docs, lengths = b.column("doc_ids")[i].values, np.array(b.column("doc_lengths")[i].values, np.int64)
            starts = np.cumsum(lengths) - lengths
            crc = [zlib.crc32(ids[s : s + n].astype("<u4")) for s, n in zip(starts.tolist(), lengths.tolist())]
            yield pa.RecordBatch.from_arrays([docs, pa.array(starts + b.column("before")[i].as_py()), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def write_token_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, byte_level: bool = False, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS, shards: int | None = None) -> DataFrame:
    """Encode every text, append ``end_id``, write the files in ascending doc_id order, and return them as a table.

    ``path`` is the place of the tokenizer's vocabulary, ``shards`` the number of
    tasks and files (default: the session's shuffle partitions).  Ties in doc_id
    are ordered by the hash of the text, so that many rows of one id, or without
    one, are dealt over several tasks; null doc_ids come first; null text is empty
    (only the end id); an empty input writes no segment.
    """
    rows = documents(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    shards = shards or max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    return materialize(dealt.mapInArrow(_write_segments(path or vocabulary(WORD_BPE), byte_level, end_id, segment_ids), _SEGMENTS), "token-blocks")


def segment_starts(files: DataFrame) -> DataFrame:
    """(shard, segment, before): ids before each segment; sums by shard first, so no task sees all segments."""
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    ahead = shards.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("ahead"))
    inside = files.select("shard", "segment", (F.sum("n_ids").over(W.partitionBy("shard").orderBy("segment")) - F.col("n_ids")).alias("inside"))
    return inside.join(ahead, "shard").select("shard", "segment", (F.col("inside") + F.col("ahead")).alias("before"))


def read_token_blocks(files: DataFrame) -> DataFrame:
    """Per document, decoded from the files: doc_id, start, n_tokens, ids_crc32."""
    placed = files.select("shard", "segment", "doc_ids", "doc_lengths", "payload").join(segment_starts(files), ["shard", "segment"])
    return placed.mapInArrow(_read_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
