"""Best-fit packing into bins of several permitted lengths.

Only lengths matter to a packing, so the plan is made on their histogram: at
most ``max(capacities)`` rows whatever the corpus size. Lengths go in falling
order; each goes to the open bins with the least room that still fits it. Where
none fits, every permitted length is tried against the lengths still waiting
and the one with the least cost per token it would hold is opened. At the end
each bin is cut down to the smallest permitted length that holds its contents.
Bins in the same state are one contiguous range, so the plan is a short table
of runs: "pieces k..k+m of length l go to bins b..b+m at offset o". Each piece
finds its run by its rank among the pieces of its length; ranks come from
counts per (length, id bucket), so no length gathers in one task.

Defined results
* a document longer than the largest capacity is split into pieces of that size.
* null or empty text: no tokens; one row with null bin columns.
* null ids form one id; repeated rows are pieces of their own; ties between
  equal pieces are interchangeable.
* empty table: empty result. Extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPACITIES = (512, 1024, 2048, 4096)
PIECES_PER_BUCKET = 4096


def training_cost(capacity: int) -> float:
    """Cost of a bin: linear work plus attention, which grows with the square."""
    return capacity * (1 + capacity / 32_768)


class Plan:
    """Best fit on a histogram of lengths. ``runs``: (length, rank, bins, bin, offset);
    ``sizes``: (bin, bins, used, capacity)."""

    def __init__(self, counts: dict[int, int], capacities=CAPACITIES, cost: Callable[[int], float] = training_cost):
        self.capacities, self.cost = sorted(capacities), cost
        self.counts = {n: c for n, c in counts.items() if n > 0 and c > 0}
        self.waiting = sorted(self.counts)  # lengths not yet placed, rising
        self.room: list[int] = []           # residuals that open bins have, rising
        self.open: dict[int, list[tuple[int, int, int]]] = {}  # residual -> (bin, bins, used)
        self.rank = dict.fromkeys(self.counts, 0)
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.bins = 0
        for n in sorted(self.counts, reverse=True):
            self._place(n)
        self.sizes = sorted((b, m, used, next(c for c in self.capacities if c >= used))
                            for states in self.open.values() for b, m, used in states)

    def _put(self, residual: int, state: tuple[int, int, int]) -> None:
        if residual not in self.open:
            self.open[residual] = []
            insort(self.room, residual)
        self.open[residual].append(state)

    def _fill(self, n: int, first: int, bins: int, used: int, residual: int) -> None:
        """Put pieces of length n into a range of like bins, as many in each as fit."""
        each, left = residual // n, self.counts[n]
        full, rest = (bins, 0) if left >= bins * each else divmod(left, each)
        for start, m, copies in ((first, full, each), (first + full, 1, rest)):
            if not m or not copies:
                continue
            for j in range(copies):
                self.runs.append((n, self.rank[n], m, start, used + j * n))
                self.rank[n] += m
            self.counts[n] -= m * copies
            self._put(residual - copies * n, (start, m, used + copies * n))
        touched = full + (1 if rest else 0)
        if touched < bins:
            self._put(residual, (first + touched, bins - touched, used))

    def _place(self, n: int) -> None:
        while self.counts[n]:
            i = bisect_right(self.room, n - 1)
            if i == len(self.room):
                break
            residual = self.room[i]
            first, bins, used = self.open[residual].pop()
            if not self.open[residual]:
                del self.open[residual]
                self.room.pop(i)
            self._fill(n, first, bins, used, residual)
        while self.counts[n]:
            capacity = self._cheapest(n)
            bins = -(-self.counts[n] // (capacity // n))
            first, self.bins = self.bins, self.bins + bins
            self._fill(n, first, bins, 0, capacity)
        self.waiting.remove(n)

    def _cheapest(self, n: int) -> int:
        """The permitted length with the least cost per token it can be filled with."""
        best = None
        for capacity in (c for c in self.capacities if c >= n):
            copies = min(capacity // n, self.counts[n])
            held, i = copies * n, bisect_right(self.waiting, n) - 1
            while held < capacity and i > 0:
                i = min(i, bisect_right(self.waiting, capacity - held)) - 1
                if i < 0:
                    break
                size = self.waiting[i]
                held += size * min((capacity - held) // size, self.counts[size])
            unit = self.cost(next(c for c in self.capacities if c >= held)) / held
            if best is None or unit < best[0]:
                best = (unit, capacity)
        return best[1]


def word_count(text):
    """Words between ASCII white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def words(text):
    """The words that ``word_count`` counts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def pieces(docs: DataFrame, id_col: str, length, longest: int) -> DataFrame:
    """(id, piece, start, n): every document cut into pieces of at most ``longest``."""
    rows = docs.select(F.col(id_col).alias("id"), length.cast("int").alias("total"))
    last = F.greatest(F.ceil(F.col("total") / longest).cast("int") - 1, F.lit(0))
    cut = rows.select("id", "total", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * longest
    return cut.select("id", "piece", start.alias("start"),
                      F.least(F.col("total") - start, F.lit(longest)).cast("int").alias("n"))


def ranked(rows: DataFrame, buckets: int) -> DataFrame:
    """Adds ``rank``: 0, 1, ... among the pieces of equal length."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)).cast("int"))
    per = rows.groupBy("n", "bucket").agg(F.count("*").alias("c"))
    before = Window.partitionBy("n").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("n", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("n", "bucket").orderBy("id", "piece", "start")
    numbered = rows.withColumn("k", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["n", "bucket"]).withColumn("rank", F.col("offset") + F.col("k"))


def pack(docs: DataFrame, length, id_col: str = "doc_id", capacities=CAPACITIES,
         cost: Callable[[int], float] = training_cost) -> DataFrame:
    """(id, piece, start, n_tokens, bin_id, bin_capacity, bin_offset) per piece.

    ``length`` is a column of token counts. Driver memory: the histogram, at
    most ``max(capacities)`` rows, and the runs planned from it.
    """
    from tickforge.llm.store import stored
    longest = max(capacities)
    cut = stored(pieces(docs, id_col, length, longest), "pieces")
    counts = {r["n"]: r["c"] for r in cut.groupBy("n").agg(F.count("*").alias("c")).collect()}
    plan = Plan(counts, capacities, cost)
    runs = np.array(sorted(plan.runs) or [(0, 0, 0, 0, 0)], dtype=np.int64)
    sizes = np.array(plan.sizes or [(0, 0, 0, 0)], dtype=np.int64)
    shift = np.int64(1) << np.int64(48)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = runs[:, 0] * shift + runs[:, 1]
        for batch in batches:
            n, rank = batch["n"].to_numpy(np.int64), batch["rank"].to_numpy(np.int64)
            run = np.maximum(np.searchsorted(keys, n * shift + rank, side="right") - 1, 0)
            bin_id = runs[run, 3] + rank - runs[run, 1]
            size = np.maximum(np.searchsorted(sizes[:, 0], bin_id, side="right") - 1, 0)
            yield pd.DataFrame({"id": batch["id"], "piece": batch["piece"], "start": batch["start"],
                                "n_tokens": n, "bin_id": bin_id, "bin_capacity": sizes[size, 3],
                                "bin_offset": runs[run, 4]})

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = (f"id {id_type}, piece int, start long, n_tokens long, bin_id long, "
              "bin_capacity long, bin_offset long")
    buckets = max(1, sum(counts.values()) // PIECES_PER_BUCKET)
    placed = ranked(cut.where("n > 0"), buckets).select("id", "piece", "start", "n", "rank").mapInPandas(assign, schema)
    nothing = F.lit(None).cast("long")
    empty = cut.where("n = 0").select("id", "piece", "start", F.col("n").cast("long").alias("n_tokens"),
                                      nothing.alias("bin_id"), nothing.alias("bin_capacity"),
                                      nothing.alias("bin_offset"))
    return placed.unionByName(empty).withColumnRenamed("id", id_col)


def sequences(docs: DataFrame, packed: DataFrame, tokens, id_col: str = "doc_id") -> DataFrame:
    """The packed sequences: one row per bin with ``bin_id``, ``bin_capacity``,
    ``n_tokens``, ``tokens`` (all pieces in order of their offsets), ``boundaries``
    (where each piece begins) and ``ids`` (the document of each piece).

    ``tokens`` is the array column whose size ``pack`` was given, words or token ids.
    A bin gathers at most its capacity. Ids must be unique, as a piece finds its
    document by id; a repeated id raises. A null id is an id.
    """
    bodies = docs.select(F.col(id_col).alias("_id"), tokens.alias("_tokens"))
    if not bodies.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"{id_col} holds repeated ids")
    held = packed.where("bin_id is not null").join(bodies, F.col(id_col).eqNullSafe(F.col("_id")))
    part = F.slice("_tokens", (F.col("start") + 1).cast("int"), F.col("n_tokens").cast("int"))
    rows = held.select("bin_id", "bin_capacity", F.struct(
        F.col("bin_offset").alias("at"), F.col("_id").alias("id"), part.alias("tokens")).alias("p"))
    bins = rows.groupBy("bin_id", "bin_capacity").agg(F.sort_array(F.collect_list("p")).alias("p"))
    flat = F.flatten(F.transform("p", lambda x: x["tokens"]))
    return bins.select("bin_id", "bin_capacity", F.size(flat).cast("long").alias("n_tokens"), flat.alias("tokens"),
                       F.transform("p", lambda x: x["at"]).alias("boundaries"), F.transform("p", lambda x: x["id"]).alias("ids"))
