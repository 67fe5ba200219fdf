"""Isolation forest for each batch and scope, after Liu, Ting and Zhou (ICDM 2008).

A scope is a category with at least 1000 supplies in the batch, all others are
pooled as "global".  Missing values take the scope's median; columns are scaled
by median and interquartile range.  Trees are grown on a bounded pool of rows,
chosen by a hash of the supply so that partitioning does not matter; every row is
scored, in tasks of bounded size.

What is known of a batch and scope (sizes, statistics, offsets) is a row for each
and is broadcast, so that the rows themselves are shuffled once, to be scored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattsift import constants as K
from wattsift.functions.scalar import risk_class
from wattsift.operators.ranks import imputed_statistics, order_statistics
from wattsift.sources.shared import cut

#: The model's columns, in order.
COLUMNS = sorted((
    "avg_consumption", "max_consumption", "min_consumption", "stddev_consumption", "pct_change_prev_period", "pct_change_yoy", "moving_avg_6m", "moving_avg_12m",
    "deviation_from_baseline", "zero_consumption_streak", "trend_slope", "seasonality_index", "peer_ratio", "supply_age_days", "prior_anomaly_count", "billed_days",
    "is_cold_start", "has_conflicted_periods", "zscore_self", "percentile_peer", "iqr_outlier_flag",
))
FLAGS = ("is_cold_start", "has_conflicted_periods", "iqr_outlier_flag")
#: Rows of a scope from which its trees draw their samples, at most, rows that one task scores, about, and rows that go through a tree together.
POOL, SCORE_ROWS, CHUNK = 8192, 50_000, 8192


def with_scope(vectors: DataFrame, least: int = K.MODEL_MIN_PER_CATEGORY) -> DataFrame:
    """Adds alcance: the category if it has ``least`` supplies in the batch, else global."""
    sizes = vectors.groupBy("lote", "categoria").agg(F.count(F.lit(1)).alias("__n"))
    return vectors.join(F.broadcast(sizes), ["lote", "categoria"]).withColumn("alcance", F.when(F.col("__n") >= least, F.col("categoria")).otherwise("global")).drop("__n")


def numeric(vectors: DataFrame) -> DataFrame:
    """The model's columns as doubles; flags are 0 and 1.  A column that is missing is an error."""
    value = lambda c: (F.col(c).cast("int") if c in FLAGS else F.col(c)).cast("double")
    return vectors.select("suministro", "lote", "alcance", *(value(c).alias(c) for c in COLUMNS))


def imputed(matrix: DataFrame, ranges: int | None = None) -> DataFrame:
    """Nulls take the median of (batch, scope), or zero if the whole column is null."""
    medians = order_statistics(matrix, ["lote", "alcance"], COLUMNS, {"_q2": 0.5}, ranges)
    return matrix.join(medians, ["lote", "alcance"], "left").select("suministro", "lote", "alcance", *(F.coalesce(c, f"{c}__q2", F.lit(0.0)).alias(c) for c in COLUMNS))


def robust_scaled(matrix: DataFrame, ranges: int | None = None) -> DataFrame:
    """Nulls filled as by ``imputed``, then (x - median) / (q3 - q1) by (batch, scope); a range of zero counts as one.

    Medians and quartiles of the filled columns come from one counting of the values.
    A row's columns are scaled as an array: as 21 expressions over 84 statistics they
    are too long a method for the JVM to compile.
    """
    stats = imputed_statistics(matrix, ["lote", "alcance"], COLUMNS, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75}, ranges)
    spread = lambda c: F.coalesce(F.nullif(F.col(f"{c}__q3") - F.col(f"{c}__q1"), F.lit(0.0)), F.lit(1.0))
    listed = lambda of, name: F.array(*map(of, COLUMNS)).alias(name)
    stats = stats.select("lote", "alcance", listed(lambda c: F.col(f"{c}_fill"), "__fill"), listed(lambda c: F.col(f"{c}__q2"), "__middle"), listed(spread, "__spread"))
    at = lambda name, i: F.get(F.col(name), i)
    scaled = F.transform(listed(F.col, "x"), lambda x, i: (F.coalesce(x, at("__fill", i)) - at("__middle", i)) / at("__spread", i))
    rows = matrix.join(F.broadcast(cut(stats, "statistics")), ["lote", "alcance"]).select("suministro", "lote", "alcance", scaled.alias("__scaled"))
    return rows.select("suministro", "lote", "alcance", *(F.get("__scaled", F.lit(i)).alias(c) for i, c in enumerate(COLUMNS)))


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of unsuccessful searches among n values."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 3)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe))


class Forest:
    """Trees as heaps: node i has children 2i + 1 and 2i + 2; leaves have feature -1 and their path length as value."""

    def __init__(self, feature: np.ndarray, split: np.ndarray, value: np.ndarray, size: int):
        self.feature, self.split, self.value, self.size = feature, split, value, size

    def to_bytes(self) -> bytes:
        head = np.array([*self.feature.shape, self.size], "<i4").tobytes()
        return head + self.split.astype("<f8").tobytes() + self.value.astype("<f4").tobytes() + self.feature.astype("i1").tobytes()

    @staticmethod
    def from_bytes(data: bytes) -> "Forest":
        trees, nodes, size = np.frombuffer(data, "<i4", 3).tolist()
        n = trees * nodes
        shaped = lambda kind, at: np.frombuffer(data, kind, n, at).reshape(trees, nodes)
        return Forest(shaped("i1", 12 + 12 * n), shaped("<f8", 12), shaped("<f4", 12 + 8 * n), size)


def fit_forest(pool: np.ndarray, trees: int = K.TREES, sample: int = K.TREE_SAMPLE, seed: int = K.SEED) -> Forest:
    """All trees at once, level by level: each node draws a column that varies in it, and a split between its ends."""
    rng = np.random.default_rng(seed)
    size = min(sample, len(pool))
    limit = int(np.ceil(np.log2(max(2, size))))
    nodes = (2 << limit) - 1
    x = pool[np.concatenate([rng.permutation(len(pool))[:size] for _ in range(trees)])]
    feature, split, value = np.full(trees * nodes, -1, np.int8), np.zeros(trees * nodes), np.zeros(trees * nodes)
    at = np.repeat(np.arange(trees) * nodes, size)  # place of each row's node among all
    for depth in range(limit + 1):
        order = np.argsort(at, kind="stable")
        x, at = x[order], at[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        count = np.diff(np.r_[first, len(at)])
        low, high = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
        varies = high > low
        choices = varies.sum(axis=1)
        inner = (choices > 0) & (depth < limit)
        own = at[first]
        value[own[~inner]] = depth + average_path(count[~inner])
        pick = np.floor(rng.random(len(first)) * choices).astype(np.int64)
        column = np.argmax(np.cumsum(varies, axis=1) > pick[:, None], axis=1)
        g = np.arange(len(first))
        border = low[g, column] + (high - low)[g, column] * np.maximum(rng.random(len(first)), 1e-9)
        feature[own[inner]], split[own[inner]] = column[inner], border[inner]
        stay = np.repeat(inner, count)
        if not stay.any():
            break
        group = np.repeat(g, count)[stay]
        x, at = x[stay], at[stay]
        tree = at // nodes * nodes
        at = tree + 2 * (at - tree) + 1 + (x[np.arange(len(x)), column[group]] >= border[group])
    return Forest(feature.reshape(trees, nodes), split.reshape(trees, nodes), value.reshape(trees, nodes), size)


def _carried_down(forest: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns, splits and values with each leaf's value at all places below it, so that every path is as long as the tree is deep."""
    inner, value = forest.feature >= 0, forest.value.copy()
    nodes = inner.shape[1]
    first = 0
    while 2 * first + 1 < nodes:
        level = np.arange(first, 2 * first + 1)
        for child in (2 * level + 1, 2 * level + 2):
            value[:, child] = np.where(inner[:, level], value[:, child], value[:, level])
        first = 2 * first + 1
    return np.maximum(forest.feature, 0).astype(np.intp), forest.split, value


def score_samples(forest: Forest, rows: np.ndarray) -> np.ndarray:
    """Minus the anomaly score: lower is stranger, from -1 to 0."""
    norm = float(average_path(forest.size))
    if not norm:
        return np.full(len(rows), -0.5)
    features, splits, values = _carried_down(forest)
    depth = (features.shape[1] + 1).bit_length() - 2
    total = np.zeros(len(rows))
    for begin in range(0, len(rows), CHUNK):
        part = np.asfortranarray(rows[begin : begin + CHUNK])
        n, flat, out = len(part), part.ravel("F"), total[begin : begin + CHUNK]
        me, at, cell = np.arange(n), np.empty(n, np.intp), np.empty(n, np.intp)
        x, border, right = np.empty(n), np.empty(n), np.empty(n, bool)
        for feature, start, split, value in zip(features, features * n, splits, values):
            np.greater_equal(part[:, feature[0]], split[0], out=right)
            np.add(right, 1, out=at)
            for _ in range(depth - 1):  # places are within bounds; "clip" spares numpy a copy
                np.add(np.take(start, at, out=cell, mode="clip"), me, out=cell)
                np.take(flat, cell, out=x, mode="clip")
                np.take(split, at, out=border, mode="clip")
                np.greater_equal(x, border, out=right)
                np.add(at, at, out=at)
                np.add(at, 1, out=at)
                np.add(at, right, out=at)
            out += value[at]
    return -np.power(2.0, -total / len(features) / norm)


def forest_scores(matrix: DataFrame, trees: int = K.TREES, seed: int = K.SEED) -> DataFrame:
    """(suministro, lote, alcance, decision) from scaled columns without nulls; decision below zero marks the contaminated share."""
    order = F.xxhash64(F.lit(seed), "suministro")
    sizes = cut(matrix.groupBy("lote", "alcance").agg(F.count(F.lit(1)).alias("__n")), "sizes")
    # of a large scope only rows below a bound of the hash, about two pools, are put in order
    drawn = matrix.join(F.broadcast(sizes), ["lote", "alcance"]).filter((F.col("__n") <= 4 * POOL) | (order / float(1 << 64) + 0.5 < 2 * POOL / F.col("__n"))).drop("__n")
    pool = drawn.withColumn("__r", F.row_number().over(W.partitionBy("lote", "alcance").orderBy(order, "suministro"))).filter(F.col("__r") <= POOL)

    def train(key, group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("__r")[COLUMNS].to_numpy(float)
        return pd.DataFrame({"lote": [key[0]], "alcance": [key[1]], "nodes": [fit_forest(rows, trees, seed=seed).to_bytes()]})

    forests = pool.groupBy("lote", "alcance").applyInPandas(train, "lote string, alcance string, nodes binary")
    counts = sizes.select("lote", "alcance", F.ceil(F.col("__n") / SCORE_ROWS).cast("int").alias("parts"))
    dealt = matrix.join(F.broadcast(counts), ["lote", "alcance"]).withColumn("part", F.pmod(F.xxhash64("suministro"), F.col("parts")).cast("int")).drop("parts")
    copies = forests.join(F.broadcast(counts.withColumnRenamed("parts", "__parts")), ["lote", "alcance"]).select("lote", "alcance", "nodes", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("part"))

    def score(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"suministro": [], "lote": [], "alcance": [], "score": []})
        return rows[["suministro", "lote", "alcance"]].assign(score=score_samples(Forest.from_bytes(model["nodes"].iloc[0]), rows[COLUMNS].to_numpy(float)))

    key = ["lote", "alcance", "part"]
    scored = dealt.groupBy(*key).cogroup(copies.groupBy(*key)).applyInPandas(score, T.StructType([*(matrix.schema[c] for c in ("suministro", "lote", "alcance")), T.StructField("score", T.DoubleType())]))
    scored = cut(scored, "forest-scores")  # it is read twice, and its plan holds the training
    offset = order_statistics(scored, ["lote", "alcance"], ["score"], {"_o": K.CONTAMINATION}).withColumnRenamed("score__o", "__o")
    return scored.join(F.broadcast(offset), ["lote", "alcance"]).select("suministro", "lote", "alcance", (F.col("score") - F.col("__o")).alias("decision"))


def ml_scores(vectors: DataFrame, trees: int = K.TREES, seed: int = K.SEED, least: int = K.MODEL_MIN_PER_CATEGORY) -> DataFrame:
    """(suministro, lote, alcance, decision, ml_score, clasificacion_ml): 0 to 100 within the batch; ``vectors`` are read several times, so they should be written."""
    from wattsift.operators.scoring import inverted_min_max

    matrix = robust_scaled(numeric(with_scope(vectors, least)))
    out = inverted_min_max(forest_scores(matrix, trees, seed), "decision", "__s").withColumn("ml_score", F.col("__s") * 100).drop("__s")
    return out.withColumn("clasificacion_ml", risk_class(F.col("ml_score")))


def top_scores(scores: DataFrame, n: int = 10) -> DataFrame:
    """The n greatest scores of each batch of (lote, alcance, numero, ml_score, ...), ties by scope and number."""
    place = F.row_number().over(W.partitionBy("lote").orderBy(F.desc("ml_score"), "alcance", "numero"))
    return scores.withColumn("puesto", place).filter(F.col("puesto") <= n)
