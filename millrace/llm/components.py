"""Connected components of a link table, by alternating stars.

Every round points each node at the smallest node it knows, in two steps that
keep the number of links from growing; a chain of any length is flattened in a
logarithmic number of rounds. Links stay distributed, and each step is settled
in the shared folder. Shuffle files and checkpoints of a round go before the next
one: with many partitions they are many small files, whatever the number of links.

A node with more than a task's share of the links (of which there can't be more
than tasks) is hot: its least neighbour, a row, is broadcast to its links, which
stay where they are. Links of other nodes meet it by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import release, settle

#: Links that one task may take of a node, whatever its share.
LINKS = 256


def _star(links: DataFrame, keep_smaller: bool, share: int) -> DataFrame:
    """One step: links ``(u, v)`` to the smallest neighbour of ``u``.

    With ``keep_smaller``, ``u``'s smaller neighbours (and ``u``) are pointed at
    the smallest, each link once; else its larger ones are, and links may repeat.
    Nodes with more than ``share`` links are hot.
    """
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"), "n")
    hot = least.filter(F.col("n") > share).select(F.col("c").alias("h"), F.col("m").alias("hm"))
    marked = links.join(F.broadcast(hot), F.col("u") == F.col("h"), "left")
    few = marked.filter("hm IS NULL").select("u", "v").join(least.filter(F.col("n") <= share), F.col("u") == F.col("c")).select("u", "v", "m")
    joined = few.unionByName(marked.filter("hm IS NOT NULL").select("u", "v", F.col("hm").alias("m")))
    if keep_smaller:
        # With the condition, which always holds, the counts are of all uses, and one shuffle serves them.
        own = least.filter("n > 0").select(F.col("c").alias("u"), F.col("m").alias("v"))
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)
        return moved.filter("u <> v").distinct()
    return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of all nodes that have a link in ``links (u, v)``; the root is the smallest node."""
    spark = links.sparkSession
    now = settle(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    stamp = _stamp(now)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while stamp[0]:
        share = max(LINKS, 2 * stamp[0] // tasks)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = settle(_star(both, False, share))
        now = settle(_star(large, True, share))
        before, stamp = stamp, _stamp(now)
        both = large = None
        release(spark)
        if stamp == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def contracted(links: DataFrame, roots: DataFrame) -> DataFrame:
    """``u, v`` between the roots of the nodes that ``links`` join; a node without a root is its own."""
    a = roots.select(F.col("node").alias("_a"), F.col("root").alias("_ra"))
    b = roots.select(F.col("node").alias("_b"), F.col("root").alias("_rb"))
    joined = links.join(a, F.col("u") == F.col("_a"), "left").join(b, F.col("v") == F.col("_b"), "left")
    return joined.select(F.coalesce("_ra", "u").alias("u"), F.coalesce("_rb", "v").alias("v")).filter("u <> v").distinct()


def _stamp(links: DataFrame) -> tuple:
    """The number of links and an order-free checksum of them."""
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).head())
