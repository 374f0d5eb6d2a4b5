"""Filling containers of fixed capacity with texts (problem 9).

Harmonic packing: a size in (C/(k+1), C/k] is of class k, and a container of
class k takes exactly k such items, so each worker fills its own containers
without knowing of the others. Items are spread by hash over groups of bounded
size. Within a group the classes are gone through from the largest sizes down;
an item first goes to the open container in which it leaves the least room, and
what finds none is put k at a time into new containers of its class. No item of
at most C is split; a larger one becomes full containers of its own and a rest
that is packed like any other.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
#: Items that one group holds on average.
GROUP = 50_000


def harmonic(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each item; all sizes are from 1 to capacity."""
    n = len(sizes)
    order = np.argsort(-sizes, kind="stable")
    classes = capacity // sizes[order]
    box = np.empty(n, dtype=np.int64)
    rooms: list[tuple[int, int]] = []  # open containers by the room left
    boxes = 0
    i = 0
    while i < n:
        k = int(classes[i])
        j = i + int(np.searchsorted(classes[i:], k, "right"))
        fresh = []
        for at in order[i:j]:
            size = int(sizes[at])
            p = bisect_left(rooms, (size, -1))
            if p < len(rooms):
                room, b = rooms.pop(p)
                box[at] = b
                if room > size:
                    rooms.insert(bisect_left(rooms, (room - size, b)), (room - size, b))
                continue
            fresh.append(at)
            if len(fresh) == k:
                room = capacity - int(sizes[fresh].sum())
                box[fresh] = boxes
                if room:
                    rooms.insert(bisect_left(rooms, (room, boxes)), (room, boxes))
                boxes += 1
                fresh = []
        if fresh:
            box[fresh] = boxes
            room = capacity - int(sizes[fresh].sum())
            if room:
                rooms.insert(bisect_left(rooms, (room, boxes)), (room, boxes))
            boxes += 1
        i = j
    return box


def pack(counts: DataFrame, rows: int, key: str = "doc_id", size: str = "tokens", capacity: int = CAPACITY) -> DataFrame:
    """``container_id, key, part, start, tokens``: each item of positive size in one container, or, where
    it exceeds the capacity, in parts from ``start`` on that fill containers and a last part.

    Items of size 0 or null go nowhere. A null key and repeated keys are items like any others.
    ``rows`` is the number of items, from which the number of groups follows. The same rows give the same containers. Empty input gives no rows.
    """
    items = counts.select(key, F.col(size).cast("long").alias("n")).filter("n > 0")
    groups = max(1, -(-rows // GROUP))
    kind = items.schema[key].dataType.simpleString()
    out = f"container_id long, {key} {kind}, part int, start long, tokens long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, "n"], kind="stable", ignore_index=True)
        n = pdf["n"].to_numpy()
        parts = -(-n // capacity)
        row = np.repeat(np.arange(len(n)), parts)
        part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = part * capacity
        take = np.minimum(capacity, n[row] - start)
        box = harmonic(take, capacity)
        return pd.DataFrame(
            {"container_id": int(pdf["g"].iloc[0]) * (1 << 32) + box, key: pdf[key].to_numpy()[row], "part": part, "start": start, "tokens": take}
        )

    spread = items.withColumn("g", F.pmod(F.xxhash64(key, "n"), F.lit(groups)))
    return spread.groupBy("g").applyInPandas(run, out)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, tokens, the least number of containers that could hold them, and the share of unused room."""
    return packed.agg(
        F.count_distinct("container_id").alias("containers"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
    ).select(
        "containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least"),
        F.when(F.col("containers") > 0, 1 - F.col("tokens") / (F.col("containers") * capacity)).alias("unused"),
    )


def placement(packed: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """``key, missing_parts, tokens_over, whole_if_it_fits`` of each item: parts that its numbers and places say are missing, how many tokens its
    fullest container holds beyond the capacity, and whether it is in one part unless it alone exceeds that. Keys are unique."""
    used = packed.groupBy("container_id").agg(F.sum("tokens").alias("used"))
    j = packed.join(used, "container_id").groupBy(key).agg(
        F.count("*").alias("n"), F.max("part").alias("last"), F.sum("tokens").alias("size"), F.max(F.col("start") + F.col("tokens")).alias("end"), F.max("used").alias("used")
    )
    return j.select(
        key, (F.abs(F.col("last") + 1 - F.col("n")) + F.abs(F.col("end") - F.col("size"))).cast("long").alias("missing_parts"),
        F.greatest(F.col("used") - capacity, F.lit(0)).cast("long").alias("tokens_over"), ((F.col("n") == 1) | (F.col("size") > capacity)).alias("whole_if_it_fits"),
    )
