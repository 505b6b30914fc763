"""Filling fixed-capacity containers (length-histogram planning).

Sizes are counted first, and best-fit-decreasing runs over the counts of the histogram, which is bounded by the
capacity and not by the number of documents.  The plan says, for each length, which ranks go to which containers;
documents take their slots by their rank within their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codeloom.tables import written

#: Rows of one length are ranked in so many independent parts, so that a hot length is no single task.
RANK_PARTS = 64
#: Budgets are parameters: a handful, and never more than this.
MAX_BUDGETS = 1000
_MISSING = np.int64(-1)


def plan_slots(counts: list[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best-fit-decreasing over (length, count) pairs, all lengths in 1..capacity.

    Returns slots (length, first rank, number, first container) with rank ``first + i`` going to container
    ``first container + i``, and the number of containers.  Containers with equal free space are one group of
    consecutive numbers; a length visits groups from the tightest that fits, so the work depends on the number of
    lengths and groups only.
    """
    slots: list[tuple[int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = {}  # free space -> [(first container, number)]
    frees: list[int] = []  # sorted
    opened = 0

    def put(free: int, first: int, number: int) -> None:
        if free > 0 and number > 0:
            if free not in groups:
                groups[free] = []
                insort(frees, free)
            groups[free].append((first, number))

    for length, count in sorted(counts, reverse=True):
        rank = 0
        while rank < count:
            at = bisect_left(frees, length)
            if at == len(frees):
                each = capacity // length
                number, rest = divmod(count - rank, each)
                for k, n in ((each, number), (rest, 1)):
                    if k and n:
                        for _ in range(k):
                            slots.append((length, rank, n, opened))
                            rank += n
                        put(capacity - k * length, opened, n)
                        opened += n
                break
            free = frees[at]
            first, number = groups[free].pop()
            if not groups[free]:
                del groups[free], frees[at]
            take = min(number, count - rank)
            slots.append((length, rank, take, first))
            rank += take
            put(free - length, first, take)
            put(free, first + take, number - take)
    return slots, opened


def pieces(sizes: DataFrame, budgets: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(budget_name, capacity, doc_id, part_no, token_from, size): a document larger than a container is divided.

    All parts but the last fill a container.  Documents without tokens, and budgets without room (null, zero or
    negative capacity), give no row.  A document id that was delivered more than once is packed once.
    """
    room = budgets.select("budget_name", (F.col("capacity_tokens") - F.coalesce("reserved_tokens", F.lit(0))).cast("int")
                          .alias("capacity")).where("capacity > 0 and budget_name is not null").distinct()
    rooms = room.orderBy("budget_name", "capacity").take(MAX_BUDGETS + 1)
    if len(rooms) > MAX_BUDGETS:
        raise ValueError(f"more than {MAX_BUDGETS} budgets")
    one = sizes.where(F.col(doc_id).isNotNull() & (F.col("tokens") > 0)).groupBy(doc_id).agg(
        F.max("tokens").alias("tokens"))
    listed = F.array(*[F.struct(F.lit(r.budget_name).alias("budget_name"), F.lit(r.capacity).alias("capacity"))
                       for r in rooms]).cast("array<struct<budget_name:string,capacity:int>>")
    each = one.select(doc_id, "tokens", F.explode(listed).alias("r"))
    each = each.select(doc_id, "tokens", "r.budget_name", "r.capacity")
    parts = F.ceil(F.col("tokens") / F.col("capacity")).cast("int")
    each = each.select("budget_name", "capacity", doc_id, "tokens",
                       F.explode(F.sequence(F.lit(0), parts - 1)).alias("part_no"))
    start = F.col("part_no").cast("bigint") * F.col("capacity")
    return each.select("budget_name", "capacity", doc_id, "part_no", start.alias("token_from"),
                       F.least(F.col("capacity"), F.col("tokens") - start).cast("int").alias("size"))


def ranked(items: DataFrame, group: list[str], order: list[str], parts: int = RANK_PARTS) -> DataFrame:
    """``items`` with ``rank`` from 0 within ``group``, formed in ``parts`` independent parts of each group."""
    salted = items.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    sizes = salted.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*group).orderBy("_part")) - F.col("_n")
    offsets = sizes.select(*group, "_part", before.alias("_before"))
    within = F.row_number().over(W.partitionBy(*group, "_part").orderBy(*order)) - 1
    return salted.withColumn("_within", within).join(offsets, [*group, "_part"]).withColumn(
        "rank", F.col("_before") + F.col("_within")).drop("_part", "_before", "_within")


def placed(items: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``items`` of :func:`pieces` with ``container`` (from 0 within its budget)."""
    items = written(items, "items")
    histogram = items.groupBy("budget_name", "capacity", "size").agg(F.count(F.lit(1)).alias("n")).collect()
    budgets = sorted({(r.budget_name, r.capacity) for r in histogram})
    width = max((c for _, c in budgets), default=0) + 1
    number = {b: i for i, b in enumerate(budgets)}
    # One sorted list of (budget, length) and ranks; an item finds its slot by binary search.
    rows: list[tuple[int, int, int, int]] = []
    for name, capacity in budgets:
        counts = [(r.size, r.n) for r in histogram if (r.budget_name, r.capacity) == (name, capacity)]
        slots, _ = plan_slots(counts, capacity)
        rows += [(number[name, capacity] * width + length, rank, n, first) for length, rank, n, first in slots]
    rows.sort()
    plan = np.array(rows, np.int64).reshape(-1, 4)
    kinds, firsts = np.unique(plan[:, 0], return_index=True)
    lasts = np.append(firsts[1:], len(plan))
    shared = items.sparkSession.sparkContext.broadcast((plan, kinds, firsts, lasts))

    @F.pandas_udf("bigint")
    def slot(kind: pd.Series, rank: pd.Series) -> pd.Series:
        plan, kinds, firsts, lasts = shared.value
        out = np.full(len(kind), _MISSING)
        ranks = rank.to_numpy()
        at = np.searchsorted(kinds, kind.to_numpy())
        for k in np.unique(at):
            rows = np.flatnonzero(at == k)
            part = plan[firsts[k]:lasts[k]]
            i = np.searchsorted(part[:, 1], ranks[rows], side="right") - 1
            out[rows] = part[i, 3] + ranks[rows] - part[i, 1]
        return pd.Series(out)

    kind = F.lit(0)
    for (name, capacity), i in number.items():
        kind = F.when((F.col("budget_name") == name) & (F.col("capacity") == capacity), i * width + F.col("size")
                      ).otherwise(kind)
    with_rank = ranked(items, ["budget_name", "capacity", "size"], [doc_id, "part_no"])
    return with_rank.withColumn("container", slot(kind.cast("bigint"), F.col("rank").cast("bigint"))).drop("rank")


def containers(items: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(budget_name, container, capacity, used_tokens, fill, n_items, contents): one row per container.

    ``contents`` lists (doc_id, part_no, token_from, size); a container holds at most ``capacity`` items, as each has
    a token at least.
    """
    return items.groupBy("budget_name", "container").agg(
        F.first("capacity").alias("capacity"), F.sum("size").alias("used_tokens"),
        (F.sum("size") / F.first("capacity")).alias("fill"), F.count(F.lit(1)).alias("n_items"),
        F.array_sort(F.collect_list(F.struct(doc_id, "part_no", "token_from", "size"))).alias("contents"))


def fill_report(boxes: DataFrame) -> DataFrame:
    """Per budget: containers, the least number that could hold the tokens, and the mean fill."""
    return boxes.groupBy("budget_name").agg(
        F.count(F.lit(1)).alias("containers"),
        F.ceil(F.sum("used_tokens") / F.first("capacity")).alias("least_containers"),
        F.sum("used_tokens").alias("tokens"), F.avg("fill").alias("mean_fill"))
