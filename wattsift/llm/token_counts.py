"""Token counts of documents from flat token files without an index.

A token file is nothing but ids (little-endian, two bytes each, or four if the
end-of-document id needs them), each document ended by the end-of-document id,
which no text may have: by default the first id behind the vocabulary.  It is read in blocks of fixed size that know nothing of
documents.  A task finds the separators of its blocks with one vectorised
comparison and returns, for each block, its length and the places of its
separators.  Running sums over the blocks of a file (a prefix scan on block
rows, not on ids) then give each block the number of documents ended before it
and the place of the last separator before it; so a document that spans many
blocks gets its whole length, and the k-th length belongs to the file's k-th
document.

``write_token_files`` makes such files from documents: a task streams its
documents' ids into blocks.  The blocks of a file are rows (file, block,
payload) of a Parquet table in the shared folder; the order of a file's
documents is kept beside them, without lengths.  ``flat_files`` reads raw binary
files as the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import documents, materialize, slices
from .tokens import BYTE_BPE, encoder, first_free_id, vocabulary

#: Ids in a block.
BLOCK_IDS = 1 << 18
#: Documents in a row of the order table.
ORDER_ROWS = 4096


def id_type(end_id: int) -> str:
    """Of the ids in a file: the end id is the greatest of them."""
    return "<u2" if end_id < 1 << 16 else "<u4"


def _write(path: str, byte_level: bool, end_id: int, block_ids: int):
    end, kind = np.array([end_id], "<u4").tobytes(), id_type(end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = TaskContext.get().partitionId()
        held, block, order, seq = np.zeros(0, kind), 0, [], 0

        def row(number: int, payload: bytes | None, docs: list | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([number], pa.int64()), pa.array([payload], pa.binary()), pa.array([docs], pa.list_(pa.int64()))], ["file", "number", "payload", "doc_ids"])

        for b in slices(batches):
            docs = b.column("doc_id").to_pylist()
            ids = np.frombuffer(b"".join(x + end for x in encoder(path, byte_level).encode(b.column("text").to_pylist())), "<u4")
            if np.count_nonzero(ids >= end_id) != len(docs):
                raise ValueError(f"texts have ids from the end id {end_id} on")
            held = np.concatenate([held, ids.astype(kind)])
            order += docs
            while len(held) >= block_ids:
                yield row(block, held[:block_ids].tobytes(), None)
                held, block = held[block_ids:], block + 1
            while len(order) >= ORDER_ROWS:
                yield row(seq, None, order[:ORDER_ROWS])
                order, seq = order[ORDER_ROWS:], seq + ORDER_ROWS
        if len(held):
            yield row(block, held.tobytes(), None)
        if order:
            yield row(seq, None, order)

    return run


def write_token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, byte_level: bool = True, end_id: int | None = None, block_ids: int = BLOCK_IDS) -> tuple[DataFrame, DataFrame, int]:
    """(blocks, order, end id): the flat files' blocks (file, block, payload), and their documents (file, first, doc_ids).

    ``end_id`` must be greater than all ids of texts; by default it is the first id behind the vocabulary.
    """
    path = path or vocabulary(BYTE_BPE)
    end_id = first_free_id(path) if end_id is None else end_id
    written = materialize(documents(docs, id_col, text_col).mapInArrow(_write(path, byte_level, end_id, block_ids), "file long, number long, payload binary, doc_ids array<long>"), "token-files", "zstd")
    blocks = written.filter(F.col("payload").isNotNull()).select("file", F.col("number").alias("block"), "payload")
    order = written.filter(F.col("doc_ids").isNotNull()).select("file", F.col("number").alias("first"), "doc_ids")
    return blocks, order, end_id


def flat_files(spark: SparkSession, pattern: str, end_id: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Raw binary token files (below 2 GB each) as rows (file, block, payload); file is a hash of the path."""
    size = np.dtype(id_type(end_id)).itemsize * block_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("file"), b.column("content")):
                whole = content.as_buffer()
                for k, at in enumerate(range(0, whole.size, size)):
                    yield pa.RecordBatch.from_pydict({"file": pa.array([file.as_py()], pa.int64()), "block": pa.array([k], pa.int64()), "payload": pa.array([whole[at : at + size].to_pybytes()], pa.binary())})

    return spark.read.format("binaryFile").load(pattern).select(F.xxhash64("path").alias("file"), "content").mapInArrow(cut, "file long, block long, payload binary")


def _scan(end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, places = [], []
            for payload in b.column("payload"):
                ids = np.frombuffer(payload.as_buffer(), id_type(end_id))
                sizes.append(len(ids))
                places.append(np.flatnonzero(ids == end_id))
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("block"), pa.array(sizes, pa.int64()), pa.array(places, pa.list_(pa.int64()))], ["file", "block", "size", "places"])

    return run


def document_lengths(blocks: DataFrame, end_id: int) -> DataFrame:
    """(file, ordinal, n_tokens) of each document that a separator ends; the separator counts as a token."""
    found = materialize(blocks.select("file", "block", "payload").mapInArrow(_scan(end_id), "file long, block long, size long, places array<long>"), "separators")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(before), F.lit(0))
    summary = found.select("file", "block", start.alias("start"), "size", F.size("places").alias("ended"), F.try_element_at("places", F.lit(-1)).alias("last"))
    summary = summary.withColumn("last_at", F.col("start") + F.col("last"))
    summary = summary.select("file", "block", "start", F.coalesce(F.sum("ended").over(before), F.lit(0)).alias("ordinal"), F.coalesce(F.max("last_at").over(before), F.lit(-1)).alias("carry"))
    placed = found.join(summary, ["file", "block"])
    ends = F.transform("places", lambda p: p + F.col("start"))
    starts = F.concat(F.array(F.col("carry")), F.slice(ends, 1, F.greatest(F.size("places") - 1, F.lit(0))))
    each = placed.filter(F.size("places") > 0).select("file", "ordinal", F.posexplode(F.zip_with(ends, starts, lambda e, s: e - s)).alias("k", "n_tokens"))
    return each.select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), "n_tokens")


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, byte_level: bool = True, end_id: int | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """One row for each document: doc_id, n_tokens (with the end id), counted in flat files made from the documents.

    Defined results: null and empty texts have one token; repeated rows are
    counted each; an empty input gives an empty result.
    """
    blocks, order, end_id = write_token_files(docs, id_col, text_col, path, byte_level, end_id, block_ids)
    ranked = order.select("file", "first", F.posexplode("doc_ids").alias("k", "doc_id")).select("file", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id")
    return ranked.join(document_lengths(blocks, end_id), ["file", "ordinal"]).select("doc_id", "n_tokens")
