"""Exact de-duplication against a minimal perfect hash of historical digests.

Texts are equal when they are identical without ASCII white space; the digest is
the SHA-256 of that form.  The distinct digests of the historical documents are
indexed in segments.  In a segment, a minimal perfect hash (hash, displace, and
direct placement of single keys) sends each of its n digests to one of n slots,
and a slot holds the whole digest and a locator of the winner.  An incoming
digest is looked up in its segment and compared byte for byte with the slot's:
members join the historical group, nonmembers form groups of their own.

Groups are formed by hash aggregation (combined before the shuffle), so only
distinct digests reach the index, however many copies a text has.  The result is
joined back on the digest; that join may be split by adaptive execution.

Defined results: null text counts as empty; all empty texts are one group; a
null doc_id loses against any other in a tie; repeated rows are copies of each
other, the result has one row for each input row, and one row of each group is
kept, also of rows that are equal in all; an empty input gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, documents, materialize

#: Distinct digests in a segment of the index, on average.
SEGMENT = 8192

_LAST = (1 << 63) - 1  # in place of a null doc_id: pandas would turn a column with nulls into floats
_INDEX = "seg long, n long, pilots binary, digests binary, winner_id binary, winner_chars binary, winner_row binary, copies binary"
_VERDICT = "digest binary, keep_id long, keep_row long, group_size long"


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)


def _place(b: np.ndarray, c: np.ndarray, pilot: np.ndarray | int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = b + np.uint64(0x9E3779B97F4A7C15) * (c | np.uint64(1)) * np.asarray(pilot, np.uint64)
        x ^= x >> np.uint64(32)
        return (x * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(11)) % np.uint64(n)


def build_perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pilots, slot of each key) for distinct 256-bit keys, as rows of four uint64; n keys fill n slots.

    A pilot of zero or more displaces the keys of its bucket together; one below
    zero names the slot of a bucket's only key.
    """
    n = len(keys)
    pilots, slots, taken = np.zeros(n, np.int32), np.full(n, -1, np.int64), np.zeros(n, bool)
    bucket = (keys[:, 0] % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
    sizes = np.diff(np.r_[starts, n])
    for g in np.argsort(-sizes, kind="stable"):
        own = order[starts[g] : starts[g] + sizes[g]]
        if sizes[g] == 1:
            break
        pilot = 0
        while True:
            at = _place(keys[own, 1], keys[own, 2], pilot, n).astype(np.int64)
            if not taken[at].any() and len(set(at.tolist())) == len(at):
                break
            pilot += 1
        taken[at], slots[own], pilots[bucket[own[0]]] = True, at, pilot
    single = order[starts[sizes == 1]]
    free = np.flatnonzero(~taken)
    slots[single], pilots[bucket[single]] = free, -free - 1
    return pilots, slots


def find_slots(keys: np.ndarray, pilots: np.ndarray) -> np.ndarray:
    """The slot that each key has if it is a member; any slot for others."""
    n = len(pilots)
    p = pilots[(keys[:, 0] % np.uint64(n)).astype(np.int64)].astype(np.int64)
    return np.where(p < 0, -p - 1, _place(keys[:, 1], keys[:, 2], np.maximum(p, 0).astype(np.uint64), n).astype(np.int64))


def _build_segment(group: pd.DataFrame) -> pd.DataFrame:
    keys = _words(group["digest"].tolist())
    pilots, slots = build_perfect_hash(keys)
    at = np.argsort(slots)
    column = lambda name: group[name].to_numpy(np.int64)[at].tobytes()
    return pd.DataFrame([{
        "seg": group["seg"].iloc[0], "n": len(group), "pilots": pilots.tobytes(), "digests": keys[at].tobytes(),
        "winner_id": column("winner_id"), "winner_chars": column("winner_chars"), "winner_row": column("winner_row"), "copies": column("copies"),
    }])


def _look_up(incoming: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    out = []
    new = np.ones(len(incoming), bool)
    if len(index):
        row = index.iloc[0]
        digests = np.frombuffer(row["digests"], "<u8").reshape(-1, 4)
        ids, chars, places, copies = (np.frombuffer(row[c], np.int64).copy() for c in ("winner_id", "winner_chars", "winner_row", "copies"))
        if len(incoming):
            keys = _words(incoming["digest"].tolist())
            slot = find_slots(keys, np.frombuffer(row["pilots"], np.int32))
            new = ~(digests[slot] == keys).all(axis=1)
            s, own = slot[~new], incoming[~new]
            i, n, at = (own[c].to_numpy(np.int64) for c in ("winner_id", "winner_chars", "winner_row"))
            wins = (n > chars[s]) | ((n == chars[s]) & (i < ids[s])) | ((n == chars[s]) & (i == ids[s]) & (at < places[s]))
            ids[s], places[s], copies[s] = np.where(wins, i, ids[s]), np.where(wins, at, places[s]), copies[s] + own["copies"].to_numpy(np.int64)
        out.append(pd.DataFrame({"digest": [x.tobytes() for x in digests], "keep_id": ids, "keep_row": places, "group_size": copies}))
    rest = incoming[new]
    out.append(pd.DataFrame({"digest": rest["digest"], "keep_id": rest["winner_id"].to_numpy(np.int64), "keep_row": rest["winner_row"], "group_size": rest["copies"]}))
    found = pd.concat(out, ignore_index=True)
    found["keep_id"] = found["keep_id"].astype("Int64").mask(found["keep_id"] == _LAST)
    return found


def normalised(text: Column) -> Column:
    return F.translate(text, ASCII_SPACE, "")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n_cp, digest) of each row of (doc_id, text), written to the shared folder; ``row`` is a number of its own."""
    text = F.col("text")
    return materialize(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.length(text).cast("long").alias("n_cp"), F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("digest")), "digests")


def groups(rows: DataFrame, segments: int) -> DataFrame:
    """A row for each distinct digest, with its winner and its copies."""
    best = F.min(F.struct((-F.col("n_cp")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("row").alias("row")))
    return rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("copies")).select(
        F.pmod(F.xxhash64("digest"), F.lit(segments)).alias("seg"), "digest", F.coalesce("best.id", F.lit(_LAST)).alias("winner_id"), (-F.col("best.less")).alias("winner_chars"), F.col("best.row").alias("winner_row"), "copies"
    )


def build_index(historical: DataFrame, segments: int) -> DataFrame:
    """The index of the historical distinct digests, a row for each segment, written to the shared folder."""
    return materialize(groups(historical, segments).groupBy("seg").applyInPandas(_build_segment, _INDEX), "digest-index")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", historical: Column | None = None, segment: int = SEGMENT) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    ``historical`` marks the rows whose digests are indexed (default: by a hash
    of doc_id, about half); the others are looked up.  The row with the most code
    points in its original text stays, then the one with the smallest doc_id.
    """
    rows = digests(documents(docs, id_col, text_col))
    old = F.coalesce(historical if historical is not None else F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    segments = max(1, -(-rows.count() // (2 * segment)))
    index = build_index(rows.filter(old), segments)
    verdict = groups(rows.filter(~old), segments).groupBy("seg").cogroup(index.groupBy("seg")).applyInPandas(_look_up, _VERDICT)
    joined = rows.join(verdict, "digest")
    return joined.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
