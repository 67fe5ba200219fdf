"""Benchmark decontamination with DataFrame functions only.

Texts are words (runs of letters and digits, lower case) and five-word shingles,
kept as 64-bit hashes.  A document is contaminated by a benchmark item if one of
its windows with as many shingles as the item (all of it, if it is shorter) has a
weighted Jaccard similarity, by the multiplicity of shingles, of at least the
threshold with the item.

1. Windows.  A window as similar as that lacks at most a known number of the
   item's shingles, so it holds one of any few more of them ("prefix": those that
   the fewest items have).  One scan finds the prefix shingles in the documents;
   hits are (text, item, place) only.  The texts with hits are read again, once for
   equal ones, and the stretches around hits of one item are cut out as one.  In
   these, places are joined with the item's shingles, and windows with enough of
   them go on.  All others are below the threshold.  The work grows with the texts
   and with the windows that go on, in any length of either.
2. SimHash.  Each such window gets a 64-bit fingerprint of its shingles.
3. Multi-index Hamming blocks.  Fingerprints are cut into 8 blocks.  Two within
   ``radius`` bits agree in one block up to radius / 8 bits; items are indexed
   under all block values that near, so the equality join on (size, block, value)
   returns every pair within the radius.
4. The exact similarity of each pair within the radius decides.

The default radius, 23 of 64 bits, is far beyond what texts at the threshold
differ by (about 10 bits, deviation 3).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, text_of

SHINGLE, THRESHOLD, RADIUS, BLOCKS = 5, 0.8, 23, 8
#: Tables of the benchmark are broadcast up to this many numbers of 8 bytes (32 MB, about twice that in memory); beyond it, joins shuffle.
BROADCAST_NUMBERS = 4_000_000


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """Hashes of all word shingles in order; none for texts with fewer words."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.transform(F.array(words), lambda w: F.when(F.size(w) >= shingle, F.transform(F.sequence(F.lit(0), F.size(w) - shingle), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(shingle))))).otherwise(F.array().cast("array<bigint>")))[0]


def simhash() -> Column:
    """64 bits of the hashes in column __w, each set if more than half of them have it set."""
    ones = lambda b: f"aggregate(__w, 0, (n, h) -> n + cast(shiftrightunsigned(h, {b}) & 1 as int))"
    return F.expr(" | ".join(f"if(2 * {ones(b)} > size(__w), shiftleft(1L, {b}), 0L)" for b in range(64)))


def weighted_jaccard(a: str, b: str) -> Column:
    """Sum of least over sum of greatest multiplicities of two array columns; shingles that repeat in both are counted, all others intersected."""
    times = lambda x: f"size(filter({x}, y -> y = h))"
    again = lambda x: f"array_distinct(filter(arrays_zip(array_sort({x}), slice(array_sort({x}), 2, size({x}))), z -> z['0'] = z['1']).`0`)"
    both = F.expr(f"size(array_intersect({a}, {b})) + if(size(array_distinct({a})) = size({a}) or size(array_distinct({b})) = size({b}), 0, aggregate(array_intersect({again(a)}, {again(b)}), 0, (n, h) -> n + least({times(a)}, {times(b)}) - 1))")
    return both / (F.size(a) + F.size(b) - both)


def benchmark_items(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, i, item, m, prefix): shingles of each item, those of the fewest items first, and how many of them a similar window cannot all lack.

    Items without a shingle can contaminate nothing and are left out; i tells two
    items of one id apart.
    """
    own = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), shingle_hashes(text_of(f"`{text_col}`"), shingle).alias("item")).filter(F.size("item") > 0).distinct()
    each = own.select("item_id", F.xxhash64("item_id", "item").alias("i"), F.explode("item").alias("h"))
    shared = each.groupBy("h").agg(F.count_distinct("i").alias("df"))
    items = each.join(shared, "h").groupBy("item_id", "i").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("all")).select("item_id", "i", F.col("all.h").alias("item"))
    # J >= t with a window of at most m shingles needs t * m common shingles at least; with m of them, 2 t m / (1 + t)
    return items.select("item_id", "i", "item", F.size("item").alias("m"), (F.size("item") - F.ceil(F.size("item") * threshold - 1e-9) + 1).cast("int").alias("prefix"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, radius: int = RADIUS, broadcast_numbers: int = BROADCAST_NUMBERS) -> DataFrame:
    """Contaminated documents: doc_id, item_id, similarity (the best window's), start (its first shingle), distance.

    A row for each (document, item) at or above the threshold.  Texts that are
    null or have fewer than five words match nothing; repeated rows give one row;
    documents without doc_id are told apart by nothing else and count as one; an
    empty side gives an empty result; other columns are ignored.
    """
    items = materialize(benchmark_items(benchmark, shingle=shingle, threshold=threshold), "benchmark-items")
    n_items, total, prefixes = items.agg(F.count(F.lit(1)), F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum("prefix"), F.lit(0))).first()
    small = lambda df, numbers: F.broadcast(df) if numbers <= broadcast_numbers else df
    first = items.select("i", "m", F.explode(F.array_distinct(F.slice("item", 1, F.col("prefix")))).alias("h"))
    text = text_of(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"), F.xxhash64(F.lit(1), text).alias("u"))  # t and u: the text in 128 bits

    places = rows.select("t", "u", shingle_hashes(F.col("text"), shingle).alias("shingles")).select("t", "u", F.size("shingles").alias("n"), F.posexplode("shingles").alias("pos", "h"))
    hits = places.join(small(first, 3 * prefixes), "h").select("t", "u", "n", "i", "m", "pos").distinct()
    # stretches: all windows of the item's size that hold a hit; those that overlap are one
    size = F.least("m", "n")
    low, high = F.greatest(F.lit(0), F.col("pos") - size + 1), F.least(F.col("n"), F.col("pos") + size)
    by = W.partitionBy("t", "u", "i").orderBy("pos")
    spread = hits.select("t", "u", "n", "i", "m", "pos", size.alias("size"), low.alias("low"), high.alias("high"))
    apart = spread.withColumn("new", F.coalesce((F.col("low") > F.max("high").over(by.rowsBetween(W.unboundedPreceding, -1))).cast("int"), F.lit(1)))
    part = apart.withColumn("part", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    stretches = part.groupBy("t", "u", "n", "i", "m", "size", "part").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    wanted = materialize(stretches.groupBy("t", "u").agg(F.collect_list(F.struct("n", "i", "m", "size", "low", "high")).alias("cuts")), "stretches")
    texts = wanted.count()
    keys = wanted.select("t", "u")
    again = rows.join(small(keys, 4 * texts), ["t", "u"], "left_semi").groupBy("t", "u").agg(F.first("text").alias("text"))
    held = again.join(wanted, ["t", "u"]).select("t", "u", "cuts", shingle_hashes(F.col("text"), shingle).alias("shingles"))
    # in pieces that hold the windows of ``size`` starts each, so that no row is longer than two windows
    pieces = "flatten(transform(cuts, c -> transform(sequence(0, cast(greatest(0, c.high - c.low - c.size) div c.size as int)), p -> struct(c.n as n, c.i as i, c.m as m, c.size as size, c.low + p * c.size as low, slice(shingles, c.low + p * c.size + 1, least(2 * c.size - 1, c.high - c.low - p * c.size)) as near))))"
    near = materialize(held.select("t", "u", F.explode(F.expr(pieces)).alias("x")).select("t", "u", "x.*"), "near")
    # windows with enough of the item's shingles: running counts at both ends
    one = ["t", "u", "i", "low"]
    members = items.select("i", F.explode(F.array_distinct("item")).alias("h"), F.lit(1).alias("own"))
    flags = near.select(*one, "size", "m", F.posexplode("near").alias("k", "h")).join(small(members, 3 * total), ["i", "h"], "left").select(*one, "size", "m", "k", F.coalesce("own", F.lit(0)).alias("own"))
    so_far = flags.withColumn("sum", F.sum("own").over(W.partitionBy(*one).orderBy("k").rowsBetween(W.unboundedPreceding, 0)))
    ends = F.explode(F.array(F.struct(F.col("k").alias("s"), (F.col("own") - F.col("sum")).alias("x")), F.struct((F.col("k") - F.col("size") + 1).alias("s"), F.col("sum").alias("x"))))
    need = F.ceil((F.col("m") + F.col("size")) * (threshold / (1 + threshold)) - 1e-9)
    counted = so_far.select(*one, "size", "m", ends.alias("e")).groupBy(*one, "size", "m", "e.s").agg(F.count(F.lit(1)).alias("ends"), F.sum("e.x").alias("inside"))
    starts = counted.filter((F.col("ends") == 2) & (F.col("inside") >= need)).groupBy(*one).agg(F.collect_list("s").alias("starts"))
    cut = near.join(starts, one).select("t", "u", "n", "low", "size", "near", F.explode("starts").alias("s"))
    content = F.array_sort(F.slice("near", F.col("s") + 1, F.col("size")))
    # windows of one text with the same shingles are one, at the first place
    windows = cut.select("t", "u", "n", "size", (F.col("low") + F.col("s")).alias("start"), content.alias("__w")).groupBy("t", "u", "n", "size", "__w").agg(F.min("start").alias("start"))
    marked = windows.select("t", "u", "n", "start", "size", "__w", simhash().alias("fp"))

    spread = _flips(64 // BLOCKS, radius // BLOCKS)
    block = F.posexplode(F.array(*(F.shiftrightunsigned("fp", 64 // BLOCKS * k).bitwiseAND(F.lit((1 << 64 // BLOCKS) - 1)) for k in range(BLOCKS))))
    prints = items.select("i", "item_id", "m", F.col("item").alias("__w")).select("i", "item_id", "m", simhash().alias("fp"))
    index = prints.select("i", "item_id", "m", F.col("fp").alias("item_fp"), block.alias("block", "v"))
    index = index.select("i", "item_id", "m", "item_fp", "block", F.explode(F.array(*(F.col("v").bitwiseXOR(F.lit(x)) for x in spread))).alias("value"))
    # a short document is one window of its own size, also for greater items: up to those of which it could hold enough
    sizes = F.sequence("size", F.when(F.col("size") == F.col("n"), F.floor(F.col("size") / threshold + 1e-9).cast("int")).otherwise(F.col("size")))
    window = ["t", "u", "start", "size"]
    prints_of = materialize(marked, "windows")
    asked = prints_of.select(*window, "fp", F.explode(sizes).alias("m")).select(*window, "fp", "m", block.alias("block", "value"))
    pairs = asked.join(small(index, 6 * n_items * len(spread) * BLOCKS), ["m", "block", "value"])
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    pairs = pairs.select(*window, "i", "item_id", distance.alias("distance")).filter(F.col("distance") <= radius).distinct()
    exact = pairs.join(prints_of.select(*window, "__w"), window).join(small(items.select("i", "item"), total + n_items), "i")
    exact = exact.select("t", "u", "item_id", "start", "distance", weighted_jaccard("__w", "item").alias("similarity")).filter(F.col("similarity") >= threshold - 1e-9)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("first"), (-F.col("distance")).alias("close")))
    found = materialize(exact.groupBy("t", "u", "item_id").agg(best.alias("b")), "contaminated")
    ids = rows.select("doc_id", "t", "u").join(small(found, 8 * found.count()), ["t", "u"])
    return ids.groupBy("doc_id", "item_id").agg(F.max("b").alias("b")).select("doc_id", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.first")).alias("start"), (-F.col("b.close")).alias("distance"))


def _flips(width: int, radius: int) -> list[int]:
    """All masks of ``width`` bits with at most ``radius`` set."""
    return [m for m in range(1 << width) if bin(m).count("1") <= radius]
