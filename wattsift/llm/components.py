"""Connected components of a link table, as joins and aggregations.

Each round hooks trees onto smaller roots and then shortens all paths (the
"FastSV" rounds of Zhang, Azad and Buluc, 2020).  A round is two joins and two
aggregations; all aggregate with ``min``, so that a node with very many links is
combined before the shuffle.  In the joins, rows of the few nodes that hold a
large share of them are spread over several keys.  A round's result is
checkpointed in the folder the cluster shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

#: A node is hot if it holds at least this share of the rows of a join's side, so there are at most 1 / HOT_SHARE; its rows go to SPREAD keys.
HOT_SHARE, SPREAD = 0.005, 64


def _hot(rows: DataFrame, column: str) -> list[int]:
    """The hot nodes of a column: at most 1 / HOT_SHARE of them."""
    counts = rows.groupBy(F.col(column).alias("node")).agg(F.count(F.lit(1)).alias("n"))
    least = F.greatest(F.lit(2), F.lit(rows.count()) * HOT_SHARE)
    return [r["node"] for r in counts.filter(F.col("n") >= least).select("node").collect()]


def _looked_up(rows: DataFrame, column: str, table: DataFrame, hot: list[int]) -> DataFrame:
    """``rows`` with the value of (node, value) for the node in ``column``; the table's hot rows are copied, and hot nodes of ``rows`` dealt to the copies."""
    is_hot = lambda c: F.col(c).isin(hot) if hot else F.lit(False)
    salt = F.when(is_hot(column), F.pmod(F.xxhash64(*rows.columns), F.lit(SPREAD))).otherwise(F.lit(0)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.when(is_hot("node"), SPREAD - 1).otherwise(0)))
    copied = table.select(F.col("node").alias("__node"), F.col("value"), copies.alias("__salt"))
    dealt = rows.withColumn("__at", salt)
    return dealt.join(copied, (F.col(column) == F.col("__node")) & (F.col("__at") == F.col("__salt"))).drop("__at", "__salt", "__node")


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``links`` (a long, b long); root is the smallest node reachable.

    Loops and repeated links are harmless; null ends are dropped; without links
    the result is empty.
    """
    shared_dir(links.sparkSession)
    both = links.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    both = both.select("a", "b").union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    hubs = _hot(both, "b")
    state = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root")).checkpoint()
    for _ in range(max_rounds):
        grand = _looked_up(state, "root", state.select("node", F.col("root").alias("value")), _hot(state, "root")).withColumnRenamed("value", "grand")
        near = _looked_up(both, "b", grand.select("node", F.col("grand").alias("value")), hubs).groupBy("a").agg(F.min("value").alias("low"))
        seen = grand.join(near.select(F.col("a").alias("node"), "low"), "node")
        offers = seen.select(F.explode(F.array(F.struct(F.col("node").alias("to"), F.least("low", "grand").alias("root")), F.struct(F.col("root").alias("to"), F.col("low").alias("root")))).alias("o"))
        best = offers.select("o.to", "o.root").groupBy("to").agg(F.min("root").alias("root"))
        after = state.select("node", F.col("root").alias("was")).join(best.withColumnRenamed("to", "node"), "node").select("node", F.least("root", "was").alias("root"), "was").checkpoint()
        changed = after.filter(F.col("root") != F.col("was")).limit(1).count()
        state = after.select("node", "root")
        if not changed:
            return state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
