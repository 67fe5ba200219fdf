"""Packing documents into sequences of bounded length: best-fit decreasing.

A document is its ids and one end id.  Documents longer than a sequence are
first cut into full windows; what is left of each document is a piece shorter
than a sequence.  Pieces are dealt into groups at random by a hash; a group
packs its pieces by falling length, each into the open sequence with the least
remaining capacity that still holds it.  A segment tree over the capacities
answers that search: leaf c counts the open sequences with capacity c left, and
the query descends to the first filled leaf at or above the length.

A group leaves about one sequence badly filled, so padding falls as groups grow;
groups are independent tasks of bounded size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from .common import documents, materialize, slices
from .tokens import BYTE_BPE, encoder, vocabulary

SEQUENCE, END_ID = 1024, 0
#: Pieces in a group, on average.
GROUP = 16_384


class CapacityTree:
    """Segment tree over 0..size: how many open sequences have each remaining capacity."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        at = capacity + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take_tightest(self, length: int) -> tuple[int, int] | None:
        """Remove and return (capacity, sequence) of the tightest open sequence that holds ``length``."""
        at, count = length + self.leaves, self.count
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at *= 2
                if not count[at]:
                    at += 1
        capacity = at - self.leaves
        while at:
            count[at] -= 1
            at >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; lengths are from 1 to ``size``."""
    tree, made = CapacityTree(size), 0
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.take_tightest(n)
        if found is None:
            found, made = (size, made), made + 1
        capacity, s = found
        sequence[i], offset[i] = s, size - capacity
        if capacity > n:
            tree.add(capacity - n, s)
    return sequence, offset


def _cut(path: str, byte_level: bool, end_id: int, size: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for b in slices(batches):
            out: dict[str, list] = {k: [] for k in ("piece", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            for doc, ids in zip(b.column("doc_id").to_pylist(), encoder(path, byte_level).encode(b.column("text").to_pylist())):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, size):
                    own = ids[4 * start : 4 * (start + size)]
                    for k, v in zip(out, (number, doc, start, len(own) // 4, zlib.crc32(own), n, own)):
                        out[k].append(v)
                    number += 1
            columns = [pa.array(v, pa.int64()) for k, v in out.items() if k != "ids"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in out["ids"]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, list(out)[: len(columns)])

    return run


def _pack_group(size: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "piece"], ascending=[False, True], ignore_index=True)
        sequence, offset = best_fit_decreasing(rows["length"].to_numpy(np.int64), size)
        # the name of a sequence is its first piece's: no other sequence can have it
        first = rows["piece"].to_numpy()[np.unique(sequence, return_index=True)[1]]
        return rows.assign(sequence_id=first[sequence], offset=offset).drop(columns="grp")

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, byte_level: bool = True, end_id: int = END_ID, size: int = SEQUENCE, group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Defined results: null and empty texts are one end id; repeated rows are
    packed each; very long texts become many full windows; an empty input gives
    an empty result.  ``path`` is the place of the tokenizer's vocabulary.
    """
    schema = "piece long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    pieces = materialize(documents(docs, id_col, text_col).mapInArrow(_cut(path or vocabulary(BYTE_BPE), byte_level, end_id, size, with_ids), schema), "pieces")
    full = pieces.filter(F.col("length") == size).select("*", F.col("piece").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < size)
    groups = max(1, -(-rest.count() // group))
    grouped = rest.withColumn("grp", F.pmod(F.xxhash64("piece"), F.lit(groups)))
    kinds = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    packed = grouped.groupBy("grp").applyInPandas(_pack_group(size), kinds)
    return full.unionByName(packed).drop("piece")


def padded_length(used: int, size: int = SEQUENCE) -> int:
    """Length after padding: a sequence is filled up to ``size`` unless its length is a power of two."""
    return used if used & (used - 1) == 0 else size
