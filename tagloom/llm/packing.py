"""Filling containers of fixed capacity with items of varying size, first-fit decreasing.

Items are spread by a random number over groups of bounded size, and each group is packed by itself: a group wastes at most about
one container, so that with thousands of items a group costs well under one in a hundred.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.session import written

#: Items of a group, about, and equal items that stay together, at most.
GROUP_ITEMS, COPIES = 20_000, 1_000


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container, from 0, of each item; no size may exceed ``capacity``. Equal sizes keep their order.

    A tournament tree holds the greatest room below each node; its leaves are containers, untouched ones with all
    their room. The first container with room is found by going left wherever the left side has room enough.
    """
    out = np.empty(len(sizes), np.int64)
    # All containers but one are at least half full, by first fit.
    most = min(len(sizes), 2 * int(-(-int(sizes.sum()) // capacity)) + 1)
    leaves = 1 << max(0, most - 1).bit_length()
    room = [capacity] * (2 * leaves)
    for item in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[item]), 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        out[item] = node - leaves
        room[node] -= size
        node //= 2
        while node:
            left, right = room[2 * node], room[2 * node + 1]
            best = left if left > right else right
            if room[node] == best:
                break
            room[node] = best
            node //= 2
    return out


def pack(items: DataFrame, item: str, size: str, capacity: int, seed: int = 0) -> DataFrame:
    """``container, item, part, start, size``: the container of each item.

    An item of more than ``capacity`` is split into parts of the whole capacity and a rest; ``part`` counts from 0
    and ``start`` is the place in the item where the part begins. Other items have one part, those of size 0 or null too.
    Rows with equal or null ids are items of their own. Containers are numbered by group and place in the group; the same items
    always get the same containers, however they are stored.
    """
    sized = items.select(F.col(f"`{item}`").alias("item"), F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("bigint").alias("size"))
    rows = written(sized.groupBy("item", "size").agg(F.count(F.lit(1)).alias("n")))
    groups = max(1, round((rows.agg(F.sum("n")).first()[0] or 0) / GROUP_ITEMS))
    kind = rows.schema["item"].dataType.simpleString()

    def packed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by([(c, "ascending") for c in ("item", "size", "chunk")])
        copies = np.repeat(np.arange(table.num_rows), table["n"].to_numpy())
        sizes = table["size"].to_numpy()[copies]
        parts = np.maximum(1, -(-sizes // capacity))
        of = np.repeat(np.arange(len(sizes)), parts)
        part = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = part * capacity
        piece = np.minimum(sizes[of] - start, capacity)
        container = first_fit_decreasing(piece, capacity) + (key[0].as_py() << 32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(container), table["item"].combine_chunks().take(pa.array(copies[of])), pa.array(part.astype(np.int32)), pa.array(start), pa.array(piece)],
            names=["container", "item", "part", "start", "size"],
        )

    # Equal items travel as numbers and in bounded lots, so that any number of copies spreads over the groups.
    lots = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / COPIES))
    placed = rows.select("item", "size", F.col("n").alias("all"), F.explode(lots).alias("chunk"))
    placed = placed.select("item", "size", "chunk", F.least(F.lit(COPIES), F.col("all") - F.col("chunk") * COPIES).alias("n"))
    placed = placed.withColumn("g", F.pmod(F.xxhash64("item", "size", "chunk", F.lit(seed)), F.lit(groups)))
    return placed.groupBy("g").applyInArrow(packed, f"container bigint, item {kind}, part int, start bigint, size bigint")
