"""Byte-balanced shards by Karmarkar-Karp differencing over groups of equal texts.

Differencing keeps partial partitions, one sum per shard, and again and again combines the two of
largest spread in opposite order. It runs on bounded sets: blocks of about ``BLOCK`` groups, then
super-blocks over the blocks' sums, and last one instance of the super-blocks' parts, every group
heavier than 1/HEAVY of all bytes and about ``RESERVE`` single groups, which even out what is left.

A group stays in one shard, unless it is heavier than a whole shard's share: then it is split by
doc_id, because no balance could hold it. Defined cases: a null text counts as the empty one; sizes
are UTF-8 bytes plus one, so no weight is zero; repeated rows belong to one group; a null doc_id is
a value like others; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import hot_join, rank_within, ship, written

SHARDS = 16
BLOCK = 1 << 14
SUPER_BLOCKS = 512
HEAVY = 4096
RESERVE = 4096


def differencing(parts: Sequence[Sequence[int]], k: int) -> list[list[int]]:
    """For each partial partition (k sums, or one sum and zeros) the final part of each of its sums."""
    nodes: list[tuple] = []
    heap: list[tuple[int, int, list[int]]] = []

    def push(sums: list[int], made: tuple) -> None:
        """Node: (order of its sums, then its two children if it has any)."""
        order = sorted(range(k), key=lambda j: (-sums[j], j))
        ranked = [sums[j] for j in order]
        nodes.append((order, *made))
        heapq.heappush(heap, (ranked[-1] - ranked[0], len(nodes) - 1, ranked))

    for p in parts:
        push(list(p) + [0] * (k - len(p)), ())
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        push([u + v for u, v in zip(x, reversed(y))], (a, b))
    out: list[list[int]] = [[] for _ in parts]
    todo = [(heap[0][1], list(range(k)))] if heap else []
    while todo:
        at, final = todo.pop()
        order, *children = nodes[at]
        by_slot = [0] * k  # final part of each unranked sum
        for j, slot in enumerate(order):
            by_slot[slot] = final[j]
        if children:
            todo += [(children[0], by_slot), (children[1], by_slot[::-1])]
        else:
            out[at] = by_slot
    return out


def _weights(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("key"))


def assign(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Add ``shard`` to rows of (key, size, doc_id): groups of one key go together, sums come out equal."""
    spark = rows.sparkSession
    ship(spark)
    per_key = written(rows.groupBy("key").agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("n")), "groups")
    total, n_rows = (x or 0 for x in per_key.agg(F.sum("weight"), F.sum("n")).first())
    share = max(1, total // shards)
    # fewer keys than shards can exceed a shard's share
    split = F.broadcast(per_key.filter(F.col("weight") > share).select("key", F.ceil(F.col("weight") * shards / share).cast("int").alias("chunks")))
    rows = rows.join(split, "key", "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("chunks")), F.lit(0)).cast("int")).drop("chunks")
    groups = per_key.filter(F.col("weight") <= share).select("key", F.lit(0).alias("chunk"), "weight", "n").unionByName(
        rows.join(split, "key").groupBy("key", "chunk").agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("n")))
    groups = written(groups.withColumn("at", F.xxhash64("key", "chunk")), "groups")
    n_groups = groups.count()
    single = (F.col("weight") * HEAVY > total) | (F.pmod(F.col("at"), F.lit(1 << 20)) < int(min(1.0, RESERVE / max(n_groups, 1)) * (1 << 20)))
    blocks = math.ceil(n_groups / BLOCK)

    def block_parts(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["weight", "key", "chunk"])
        return g.assign(part=[p[0] for p in differencing([[w] for w in g["weight"].tolist()], shards)])

    block = F.shiftrightunsigned("at", 20) % max(blocks, 1)
    parts = written(groups.filter(~single).withColumn("block", block).groupBy("block").applyInPandas(
        block_parts, groups.schema.simpleString()[7:-1] + ",block:long,part:long"), "parts")

    def super_parts(g: pd.DataFrame) -> pd.DataFrame:
        sums = g.pivot_table(index="block", columns="part", values="weight", aggfunc="sum", fill_value=0)
        sums = sums.reindex(columns=range(shards), fill_value=0)
        found = differencing(sums.astype(np.int64).values.tolist(), shards)
        out = pd.DataFrame(found, index=sums.index).stack().rename("over").rename_axis(["block", "part"]).reset_index()
        return out.merge(g, on=["block", "part"])[["super", "block", "part", "over", "weight"]]

    over = written(parts.groupBy("block", "part").agg(F.sum("weight").alias("weight")).withColumn("super", F.col("block") % SUPER_BLOCKS)
                   .groupBy("super").applyInPandas(super_parts, "super long, block long, part long, over long, weight long"), "parts")

    # bounded last instance: shards * SUPER_BLOCKS parts, HEAVY groups and about RESERVE groups
    bundles = over.groupBy("super", "over").agg(F.sum("weight").alias("weight")).orderBy("super", "over").collect()
    singles = groups.filter(single).select("key", "chunk", "weight").orderBy("key", "chunk").collect()
    final = differencing([[r["weight"]] for r in [*bundles, *singles]], shards)
    bundle_shard = spark.createDataFrame([(r["super"], r["over"], f[0]) for r, f in zip(bundles, final)], "super long, over long, shard int")
    single_shard = spark.createDataFrame([(r["key"], r["chunk"], f[0]) for r, f in zip(singles, final[len(bundles):])], "key binary, chunk int, shard int")

    placed = parts.join(over.select("block", "part", "super", "over"), ["block", "part"]).join(F.broadcast(bundle_shard), ["super", "over"])
    placed = written(placed.select("key", "chunk", "shard", "n").unionByName(
        groups.filter(single).join(F.broadcast(single_shard), ["key", "chunk"]).select("key", "chunk", "shard", "n")), "placed")
    return hot_join(rows, placed, ["key", "chunk"], "n", n_rows).drop("n", "chunk")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): slots are gapless from 0 within a shard."""
    rows = written(_weights(docs), "weights")
    placed = assign(rows, shards)
    total = rows.count()
    return rank_within(placed, "shard", [F.col("doc_id"), F.col("key")], [F.col("doc_id"), F.col("key")], total, "slot").select(
        "doc_id", "size", "text_crc32", "shard", "slot")
