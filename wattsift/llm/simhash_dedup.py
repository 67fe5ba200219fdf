"""Near-duplicates by SimHash, linked by a binary trie joined with itself.

A fingerprint has a bit for each of 64: set if more than half of the document's
shingle hashes (XXH64 of the word shingles, repeats included) have it set.

The distinct fingerprints form a binary trie over their bits, high bits first.
The trie's upper part is a table: nodes that hold more than ``node_size``
fingerprints are split, others are leaves.  Leaves whose common prefix differs
in at most ``radius`` bits are paired; each pair is a task that goes on down both
subtries together, adds up differing bits, and drops a pair of nodes when the
error budget is spent.  So every pair of fingerprints within the radius meets in
exactly one task.  A task links what it finds with a union-find of its own and
returns at most one link per fingerprint, however dense the group is; components
are then found over all links.

Copies share a fingerprint and are one entry, so their number does not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, slices
from .components import connected_components

SEED, RADIUS, WORDS = 42, 2, 3
#: Distinct fingerprints in a leaf of the distributed part of the trie, at most: at depth 62 there are no more than 4.
NODE_SIZE, DEEPEST = 4096, 62
#: Node pairs that one step of a task holds at once.
FRONTIER = 1 << 19

_BITS = np.array([[(byte >> (7 - k)) & 1 for k in range(8)] for byte in range(256)], np.uint8)


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of a text; words are runs without ASCII white space, with A-Z in lower case."""
    w = text.encode().lower().split()
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    grams = zip(*(w[i:] for i in range(words))) if len(w) > words else [w]
    hashes = np.array([h(g, seed) for g in map(b" ".join, grams)], ">u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">u8")[0])


def _fingerprints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = np.array([fingerprint(t, words, seed) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of each row of (doc_id, text); fp holds the unsigned bits as a long."""
    return docs.mapInArrow(_fingerprints(words, seed), "doc_id long, fp long")


def _children(values: np.ndarray, bit: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Where the ones begin in each range of sorted values that agree above ``bit``."""
    ones = np.concatenate([[0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1))]).astype(np.int64)
    return hi - (ones[hi] - ones[lo])


def linked_pairs(a: np.ndarray, b: np.ndarray, same: bool, radius: int, depth: int = 0, small: int = 8, frontier: int = FRONTIER, known: Callable[..., np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) with a[i] and b[j] within ``radius`` bits, by going down both tries together.

    a and b are sorted and each agrees in its first ``depth`` bits.  With
    ``same`` they are one array, and only i < j are given.  Pairs of nodes with
    few members are compared directly.  ``known`` may mark pairs of nodes
    (ranges al:ah of a and bl:bh of b) that need not be compared any more.
    """
    if not len(a) or not len(b):
        return
    miss = bin((int(a[0]) ^ int(b[0])) >> (64 - depth)).count("1") if depth else 0
    one = lambda *x: tuple(np.array([v], np.int64) for v in x)
    stack = [(depth, *one(0, len(a), 0, len(b), miss))]
    while stack:
        d, al, ah, bl, bh, err = stack.pop()
        if len(al) > frontier:
            half = len(al) // 2
            stack += [(d, *(x[:half] for x in (al, ah, bl, bh, err))), (d, *(x[half:] for x in (al, ah, bl, bh, err)))]
            continue
        if known is not None and len(al):
            al, ah, bl, bh, err = (x[keep] for keep in [~known(al, ah, bl, bh)] for x in (al, ah, bl, bh, err))
        few = ((ah - al) * (bh - bl) <= small * small) if d < 64 else np.ones(len(al), bool)
        if few.any():
            n, m = (ah - al)[few], (bh - bl)[few]
            size = n * m
            k = np.repeat(np.arange(len(size)), size)
            at = np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size)
            i, j = al[few][k] + at // m[k], bl[few][k] + at % m[k]
            near = np.bitwise_count(a[i] ^ b[j]) <= radius
            if same:
                near &= i < j
            if near.any():
                yield i[near], j[near]
            al, ah, bl, bh, err = (x[~few] for x in (al, ah, bl, bh, err))
        if not len(al):
            continue
        bit = 63 - d
        am, bm = _children(a, bit, al, ah), _children(b, bit, bl, bh)
        parts = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1), (am, ah, bl, bm, err + 1)]
        if same:  # of a node with itself, one of the mixed pairs is enough
            parts[3] = tuple(x[al != bl] for x in parts[3])
        al, ah, bl, bh, err = (np.concatenate(x) for x in zip(*parts))
        ok = (ah > al) & (bh > bl) & (err <= radius)
        stack.append((d + 1, *(x[ok] for x in (al, ah, bl, bh, err))))


class _Sets:
    """Union-find over positions, with the smallest member as root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while True:
            ri, rj = root[i], root[j]
            if (ri == rj).all():
                return
            low, high = np.minimum(ri, rj), np.maximum(ri, rj)
            np.minimum.at(root, high, low)
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


def _link_task(radius: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy(np.int64).view(np.uint64)
        right = rows["right"].to_numpy(bool)
        same, depth = bool(rows["same"].iloc[0]), int(rows["depth"].iloc[0])
        a = np.sort(fp[~right])
        b = a if same else np.sort(fp[right])
        every = a if same else np.concatenate([a, b])
        sets, shift = _Sets(len(every)), 0 if same else len(a)
        for i, j in linked_pairs(a, b, same, radius, depth):
            sets.join(i, j + shift)
        moved = np.flatnonzero(sets.root != np.arange(len(every)))
        return pd.DataFrame({"x": every[sets.root[moved]].view(np.int64), "y": every[moved].view(np.int64)})

    return run


def _leaves(fps: DataFrame, node_size: int, n: int) -> DataFrame:
    """(fp, depth, node): the leaf of the trie's upper part in which each distinct fingerprint lies.

    Some levels are tried at once; fingerprints whose node is too large at the last of them go on to the next levels.
    """
    first = 0
    while n > node_size << first:
        first += 2
    prefix = lambda d: F.shiftrightunsigned("fp", 64 - d) if d else F.lit(0).cast("long")
    rest, found = fps, []
    while True:
        depths = list(range(first, min(DEEPEST, first + 8) + 1, 2))
        at = rest.select("fp", F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), prefix(d).alias("node")) for d in depths))).alias("n")).select("fp", "n.depth", "n.node")
        counts = at.groupBy("depth", "node").agg(F.count(F.lit(1)).alias("size"))
        fits = counts.filter((F.col("size") <= node_size) | (F.col("depth") == DEEPEST)).select("depth", "node")
        found.append(at.join(fits, ["depth", "node"]).groupBy("fp").agg(F.min(F.struct("depth", "node")).alias("leaf")).select("fp", "leaf.depth", "leaf.node"))
        last = depths[-1]
        if last >= DEEPEST:
            break
        large = materialize(counts.filter((F.col("depth") == last) & (F.col("size") > node_size)).select("node"), "trie-large-nodes")
        if not large.limit(1).count():
            break
        rest = materialize(rest.join(large, prefix(last) == F.col("node"), "left_semi"), "trie-rest")
        first = last + 2
    return reduce(DataFrame.union, found)


def _flips(width: int, radius: int) -> list[int]:
    masks, last = {0}, {0}
    for _ in range(radius):
        last = {m ^ (1 << k) for m in last for k in range(width)}
        masks |= last
    return sorted(masks)


def node_pairs(leaves: DataFrame, radius: int) -> DataFrame:
    """Pairs of leaves whose common prefix differs in at most ``radius`` bits: (ld, ln, rd, rn), the deeper one left.

    Each leaf asks, at its own and each lesser depth, for the nodes around its prefix.
    """
    nodes = leaves.select("depth", "node").distinct()
    depths = [r[0] for r in nodes.select("depth").distinct().collect()]  # at most 32 values
    asked = None
    for d in sorted(depths):
        masks = F.array(*(F.lit(m).cast("long") for m in _flips(d, radius)))
        own = nodes.filter(F.col("depth") >= d).select(F.col("depth").alias("ld"), F.col("node").alias("ln"), F.expr(f"shiftrightunsigned(node, depth - {d})").alias("up"), F.explode(masks).alias("mask"))
        own = own.select("ld", "ln", F.lit(d).alias("rd"), F.col("up").bitwiseXOR(F.col("mask")).alias("rn"))
        asked = own if asked is None else asked.union(own)
    if asked is None:
        return nodes.select(F.col("depth").alias("ld"), F.col("node").alias("ln"), F.col("depth").alias("rd"), F.col("node").alias("rn"))
    found = asked.join(nodes.select(F.col("depth").alias("rd"), F.col("node").alias("rn")), ["rd", "rn"])
    return found.filter((F.col("ld") > F.col("rd")) | (F.col("ln") >= F.col("rn"))).select("ld", "ln", "rd", "rn")


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, node_size: int = NODE_SIZE) -> DataFrame:
    """Links (x, y) between distinct fingerprints that give the same components as all pairs within the radius."""
    fps = fps.select("fp").distinct()
    leaves = materialize(_leaves(fps, node_size, fps.count()), "trie-leaves")
    pairs = node_pairs(leaves, radius).withColumn("pair", F.xxhash64("ld", "ln", "rd", "rn")).withColumn("same", (F.col("ld") == F.col("rd")) & (F.col("ln") == F.col("rn")))
    pairs = materialize(pairs, "trie-pairs")
    left = leaves.join(pairs.select(F.col("ld").alias("depth"), F.col("ln").alias("node"), "pair", F.col("rd").alias("common"), "same"), ["depth", "node"]).select("pair", "same", F.col("common").alias("depth"), F.lit(False).alias("right"), "fp")
    right = leaves.join(pairs.filter(~F.col("same")).select(F.col("rd").alias("depth"), F.col("rn").alias("node"), "pair", F.col("rd").alias("common"), "same"), ["depth", "node"]).select("pair", "same", F.col("common").alias("depth"), F.lit(True).alias("right"), "fp")
    return left.union(right).groupBy("pair").applyInPandas(_link_task(radius), "x long, y long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS, node_size: int = NODE_SIZE, seed: int = SEED) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable).

    Defined results: a text without words (null, empty or white space) has
    fingerprint zero, which links like any other; repeated rows share a
    component; a null doc_id never is a component's id unless all are null; an
    empty input gives an empty result; other columns are ignored.
    """
    rows = materialize(fingerprints(documents(docs, id_col, text_col), words, seed), "fingerprints")
    firsts = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    links = fingerprint_links(rows, radius, node_size)
    roots = connected_components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
    least = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    component = least.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = least.join(component, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Near copies of a given similarity.  At a similarity of 0.8 two 64-bit
# fingerprints differ in some ten bits, where a trie over all documents prunes
# almost nothing.  So the trie join runs within blocks: documents that share the
# three min-wise shingles of one of 15 bands.
#
# The first bands are compared first.  They link nearly all that is similar, and
# blocks of the other bands whose texts are all of one component then are passed
# over.
#
# No task holds a whole block that is large.  First such a block is dealt into
# slices; each is compared within itself and with a few pivots of the block, which
# joins most of a large group of near copies.  Then all pairs of parts of the block
# are compared, each pair as its own task; only parts that are known to be of one
# component, or whose texts differ too much in size, are passed over.

SIMILAR_WORDS, SIMILARITY = 5, 0.8
#: Error budget of the trie join within blocks; texts at a similarity of 0.8 differ in 10 bits, deviation 3.
SIMILAR_RADIUS = 22
#: Bands of min-wise shingles, and shingles in each: at similarity s two texts share none with probability (1 - s ** ROWS) ** BANDS (2e-5 at 0.8).
BANDS, ROWS = 15, 3
#: Bands that are compared first.
FIRST_BANDS = 4
#: Least shingle hashes of a document by which pairs clearly below the similarity are passed over, and how far below the
#: estimate may be (six deviations at 0.8); the full shingle sets decide on the others.
SKETCH, SLACK = 64, 0.3
#: Texts of a block that one task takes whole, and of a part of a larger block (about).
BLOCK = 2048
#: Texts that one task takes from small blocks, about.
DEALT = 1024
#: Texts of a block that are compared with all others before the trie join, and pairs compared at once.
PIVOTS, PAIRS = 16, 4096
#: Shingles that are hashed for the bands at once.
_AT_ONCE = 4096
#: Fills up the sketches of short texts.
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

_MIX = np.array([xxhash.xxh64_intdigest(f"band {k}") | 1 for k in range(BANDS * ROWS)], np.uint64)  # odd multipliers


def _shingles(text: str, words: int) -> np.ndarray:
    """Hashes of all word shingles, repeats included."""
    w = text.encode().lower().split()
    grams = zip(*(w[i:] for i in range(words))) if len(w) > words else [w]
    h = xxhash.xxh64_intdigest
    return np.array([h(g, SEED) for g in map(b" ".join, grams)], np.uint64)


def _digest(distinct: np.ndarray) -> int:
    return int(np.array(xxhash.xxh64_intdigest(distinct.astype("<u8").tobytes(), SEED), np.uint64).view(np.int64))


def band_keys(distinct: np.ndarray) -> np.ndarray:
    """A key for each band: a hash of the min-wise shingles of its rows."""
    least = np.full(len(_MIX), _NONE)
    for start in range(0, len(distinct), _AT_ONCE):
        x = distinct[start : start + _AT_ONCE]
        mixed = (x ^ (x >> np.uint64(29)))[:, None] * _MIX
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
    rows = least.astype("<u8").reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64)


def _profiles(words: int):
    """fp, digest of the set of shingles, their number, and the keys of the bands of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps, digests, keys, sizes = [], [], [], []
            for text in b.column("text").to_pylist():
                x = _shingles(text, words)
                ones = np.unpackbits(x.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
                fps.append(np.packbits(ones * 2 > len(x)).view(">u8")[0])
                x = np.unique(x)
                digests.append(_digest(x))
                keys.append(band_keys(x))
                sizes.append(len(x))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(digests, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int32())], ["doc_id", "fp", "s", "keys", "size"])

    return run


def _sets_of(words: int):
    """The distinct shingle hashes of each text, in rising order, and their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [np.unique(_shingles(text, words)) for text in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(_digest, found), pa.int64()), pa.array([x.astype("<u8").tobytes() for x in found], pa.binary())], ["u", "s", "shingles"])

    return run


def estimated_similarities(sketches: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Jaccard similarity of the sets of each pair of rows from their least hashes; exact if no set is larger than a sketch.

    A row holds a sketch in rising order, filled up with ``_NONE``.
    """
    both = np.sort(np.concatenate([sketches[i], sketches[j]], axis=1), axis=1)
    again = np.zeros(both.shape, bool)
    again[:, 1:] = both[:, 1:] == both[:, :-1]
    real = both != _NONE
    full = (sketches[i, -1] != _NONE) | (sketches[j, -1] != _NONE)
    counted = real & (np.cumsum(real & ~again, axis=1) <= np.where(full, SKETCH, 2 * SKETCH)[:, None])
    return (counted & again).sum(axis=1) / np.maximum(1, (counted & ~again).sum(axis=1))


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sets of hashes is at least so much."""
    least, most = (len(a), len(b)) if len(a) < len(b) else (len(b), len(a))
    if least < similarity * most - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _link_few(fp: np.ndarray, root: np.ndarray, sets: list[np.ndarray], right: np.ndarray, radius: int, similarity: float) -> np.ndarray:
    """Roots after all pairs of a few texts are compared."""
    root = root.copy()
    cross = right.any()
    for j in range(1, len(fp)):
        for i in range(j):
            if root[i] != root[j] and (not cross or right[i] != right[j]) and int(fp[i] ^ fp[j]).bit_count() <= radius and similar(sets[i], sets[j], similarity):
                low, high = sorted((root[i], root[j]))
                root[root == high] = low
    return root


def _link_many(fp: np.ndarray, root: np.ndarray, shingles: list[np.ndarray], right: np.ndarray, radius: int, similarity: float) -> np.ndarray:
    """The same for many texts, ordered by (right, fp), by the trie join.

    A few texts are compared with all others first.  In a large group of near
    copies that joins nearly all; the trie join then passes over pairs of nodes
    whose texts are of one component already.
    """
    n = len(fp)
    same, shift = not right.any(), 0 if not right.any() else int((~right).sum())
    sketches = np.full((n, SKETCH), _NONE)
    for k, own in enumerate(shingles):
        sketches[k, : min(SKETCH, len(own))] = own[:SKETCH]
    sets = _Sets(n)
    sets.root[:] = root
    root = sets.root

    def link(i: np.ndarray, j: np.ndarray) -> None:
        for at in range(0, len(i), PAIRS):
            x, y = i[at : at + PAIRS], j[at : at + PAIRS]
            open_ = root[x] != root[y]
            x, y = x[open_], y[open_]
            like = estimated_similarities(sketches, x, y) >= similarity - SLACK
            for k in np.flatnonzero(like):
                if root[x[k]] != root[y[k]] and similar(shingles[x[k]], shingles[y[k]], similarity):
                    sets.join(x[k : k + 1], y[k : k + 1])

    def known(al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray) -> np.ndarray:
        bl, bh = bl + shift, bh + shift
        changes = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
        return (changes[ah - 1] == changes[al]) & (changes[bh - 1] == changes[bl]) & (root[al] == root[bl]) & ((al != bl) | (ah - al > 1))

    tried = np.zeros(n, bool)
    for _ in range(PIVOTS if n > PIVOTS else 0):
        alone = np.flatnonzero((root == np.arange(n)) & (np.bincount(root, minlength=n) == 1) & ~tried)
        if not len(alone):
            break
        tried[alone[0]] = True
        near = np.flatnonzero(np.bitwise_count(fp ^ fp[alone[0]]) <= radius)
        link(np.full(len(near), alone[0]), near)
    a, b = (fp, fp) if same else (fp[:shift], fp[shift:])
    for i, j in linked_pairs(a, b, same, radius, frontier=1 << 15, known=known):
        link(i, j + shift)
    return root


def _similar_task(radius: int, similarity: float):
    """Links within each block of the rows, or between its two sides if some of its rows are ``right``; at most one for each text.

    Texts of one ``root`` are known to be of one component.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        fp, right, key = rows["fp"].to_numpy(np.int64).view(np.uint64), rows["right"].to_numpy(bool), rows["block"].to_numpy(np.int64)
        u, given, shingles = rows["u"].to_numpy(np.int64), rows["root"].to_numpy(np.int64), rows["shingles"].to_numpy()
        order = np.lexsort((u, fp, right, key))
        ends = np.flatnonzero(np.r_[np.diff(key[order]) != 0, True]) + 1
        x, y, start = [], [], 0
        for end in ends.tolist():
            own, start = order[start:end], end
            _, first, place = np.unique(given[own], return_index=True, return_inverse=True)
            if len(first) < 2:
                continue
            before = first[place]
            link = _link_few if len(own) <= PIVOTS else _link_many
            after = link(fp[own], before, [np.frombuffer(shingles[k], "<u8") for k in own], right[own], radius, similarity)
            moved = np.flatnonzero((after != before) & (before == np.arange(len(own))))
            x.append(u[own[after[moved]]])
            y.append(u[own[moved]])
        none = [np.zeros(0, np.int64)]
        return pd.DataFrame({"x": np.concatenate(x + none), "y": np.concatenate(y + none)})

    return run


def _slice(n: str, block: int) -> Column:
    """The slice of a text when n of them are dealt into slices of about ``block``."""
    return F.pmod(F.xxhash64("u", "key"), F.ceil(F.col(n) / block)).cast("int")


def block_slices(large: DataFrame, block: int) -> DataFrame:
    """(u, root, key, slice) of large blocks, with some pivots of a block in each of its slices."""
    pivots = large.groupBy("key", "n", F.pmod(F.xxhash64("u"), F.lit(PIVOTS)).alias("p")).agg(F.min(F.struct("u", "root")).alias("t"))
    pivots = pivots.select("t.u", "t.root", "key", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / block) - 1).cast("int"))).alias("slice"))
    return large.select("u", "root", "key", _slice("n", block).alias("slice")).union(pivots)


def band_members(keyed: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(u, root, size, key, n): the texts in blocks of (u, size, key) that hold more than one component."""
    if roots is None:
        named = keyed.withColumn("root", F.col("u"))
    else:
        named = keyed.join(roots.select(F.col("node").alias("u"), "root"), "u", "left").withColumn("root", F.coalesce("root", "u"))
    sizes = named.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key", "n")
    return materialize(named.join(sizes, "key").select("u", "root", "size", "key", "n"), "block-members")


def band_links(member: DataFrame, content: DataFrame, task, block: int, dealt: int) -> DataFrame:
    """Links within small blocks, many to a task, and within slices of large ones."""
    small, large = member.filter(F.col("n") <= block), member.filter(F.col("n") > block)
    tasks = max(1, -(-small.count() // dealt))
    few = small.select("u", "root", F.col("key").alias("block"), F.pmod(F.xxhash64("key"), F.lit(tasks)).alias("part"))
    sliced = block_slices(large, block).select("u", "root", F.xxhash64("key", "slice").alias("block")).withColumn("part", F.col("block"))
    rows = few.union(sliced).join(content, "u").withColumn("right", F.lit(False))
    return materialize(rows.groupBy("part").applyInPandas(task, "x long, y long").distinct(), "similar-links")


def part_pairs(large: DataFrame, roots: DataFrame, block: int, similarity: float) -> DataFrame:
    """(pair, right, u, root): the texts of each pair of parts of the blocks in (u, key, size) that can hold a new link.

    A part is of one component, if enough of the block's texts are, or of the rest
    of the block; and of one class of sizes.  The sizes of two texts of the
    similarity differ at most by that factor, so their classes are the same or neighbours.
    """
    level = F.floor(F.log(F.col("size")) / -np.log(similarity - 1e-9)).cast("int")
    texts = large.join(roots.select(F.col("node").alias("u"), "root"), "u", "left").select("u", "key", F.coalesce("root", "u").alias("root"), level.alias("level"))
    # blocks that are of one component by now have no new link
    mixed = texts.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    texts = materialize(texts.join(mixed, "key"), "block-texts")
    grown = texts.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > block).select("key", "root", F.col("root").alias("of"))
    texts = texts.join(grown, ["key", "root"], "left").select("u", "key", "root", "of", "level", F.xxhash64("of", "level").alias("g"))
    sizes = texts.groupBy("key", "g").agg(F.count(F.lit(1)).alias("n"), F.first("of").alias("of"), F.first("level").alias("level"))
    texts = materialize(texts.join(sizes.select("key", "g", "n"), ["key", "g"]).select("u", "key", "root", "of", "level", F.xxhash64("g", _slice("n", block)).alias("part")), "block-parts")
    parts = texts.groupBy("key", "part").agg(F.first("of").alias("of"), F.first("level").alias("level"))
    other = parts.select("key", *(F.col(c).alias(f"{c}2") for c in ("part", "of", "level")))
    pairs = parts.join(other, "key").filter((F.col("part") <= F.col("part2")) & (F.abs(F.col("level") - F.col("level2")) <= 1) & ~F.coalesce(F.col("of") == F.col("of2"), F.lit(False)))
    pairs = materialize(pairs.select("key", "part", "part2", F.xxhash64("key", "part", "part2").alias("pair")), "part-pairs")
    left = texts.join(pairs, ["key", "part"]).select("pair", F.lit(False).alias("right"), "u", "root")
    right = texts.join(pairs.filter("part < part2").select("key", F.col("part2").alias("part"), "pair"), ["key", "part"]).select("pair", F.lit(True).alias("right"), "u", "root")
    return left.union(right)


def _roots(links: DataFrame) -> DataFrame:
    return connected_components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SIMILAR_WORDS, similarity: float = SIMILARITY, radius: int = SIMILAR_RADIUS, block: int = BLOCK, dealt: int = DEALT) -> DataFrame:
    """Groups of near copies: doc_id, group_id (the smallest doc_id of the group); ids without a near copy are left out.

    Texts without words are one text; two rows of one doc_id are one document; rows without doc_id are left out.
    Two texts are linked if their fingerprints (over ``words``-word shingles) are
    within ``radius`` bits and the Jaccard similarity of their shingle sets is at
    least ``similarity``.  Groups are the components of the links.  A task holds about
    two times ``block`` texts at most.
    """
    given = documents(docs, id_col, text_col).filter(F.col("doc_id").isNotNull())
    rows = materialize(given.mapInArrow(_profiles(words), "doc_id long, fp long, s long, keys array<long>, size int"), "profiles")
    # one row for each distinct set of shingles with its fingerprint, named by its smallest doc_id
    texts = rows.groupBy("fp", "s").agg(F.min("doc_id").alias("u"), F.min("keys").alias("keys"), F.min("size").alias("size"))
    texts = materialize(texts, "distinct-profiles")
    task = _similar_task(radius, similarity)
    bands = lambda a, b: texts.select("u", "size", F.explode(F.slice("keys", a + 1, b - a)).alias("key"))
    # the full sets, of the texts that share a block only
    shared = bands(0, BANDS).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    needed = texts.join(bands(0, BANDS).join(shared, "key").select("u").distinct(), "u", "left_semi").select("u", "s", "fp")
    full = given.join(needed.select(F.col("u").alias("doc_id")), "doc_id", "left_semi").mapInArrow(_sets_of(words), "u long, s long, shingles binary")
    content = materialize(full.join(needed, ["u", "s"]).dropDuplicates(["u", "s", "fp"]).select("u", "fp", "shingles"), "shingle-sets")
    member = band_members(bands(0, FIRST_BANDS), None)
    links = band_links(member, content, task, block, dealt)
    rest = band_members(bands(FIRST_BANDS, BANDS), _roots(links))
    links = links.union(band_links(rest, content, task, block, dealt))
    large = member.union(rest).filter(F.col("n") > block).select("u", "key", "size")
    if large.limit(1).count():
        pairs = part_pairs(large, _roots(links), block, similarity).join(content, "u")
        found = pairs.select(F.col("pair").alias("part"), F.col("pair").alias("block"), "u", "root", "right", "fp", "shingles").groupBy("part").applyInPandas(task, "x long, y long")
        links = links.union(materialize(found.distinct(), "similar-links-of-parts"))
    roots = _roots(links)
    copies = rows.select("doc_id", "fp", "s").join(texts.select("fp", "s", "u"), ["fp", "s"])
    grouped = copies.join(roots.select(F.col("node").alias("u"), "root"), "u", "left").select("doc_id", F.coalesce("root", "u").alias("group_id"), F.col("root").isNotNull().alias("linked"))
    return grouped.filter(F.col("linked") | (F.col("doc_id") != F.col("group_id"))).select("doc_id", "group_id")
