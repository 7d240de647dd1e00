"""Benchmark decontamination by q-gram lemma filtering in diagonal bands.

An item of m characters that occurs in a document with at most k edits shares
at least ``m + 1 - q - k*q`` q-grams with that stretch, and their diagonals
(document position minus item position) differ by at most k. Hits are counted
per item in bands of 2k+1 diagonals that start every k diagonals, so one band
holds all hits of such a stretch. Bands that meet the bound are verified by a
banded alignment. Both sides are compared in a normal form: lower case, every
run of characters other than letters and digits one space.

The benchmark is sent to the tasks in slices of at most ``slice_bytes``, so a
benchmark of any size runs in bounded memory; documents are never shuffled.

Defined results
* null or empty text: clean. Null ids pass through; repeated rows are judged row by row.
* very long texts: whole. Hits are counted in runs of at most ``RUN`` pairs of grams,
  so a text and an item that repeat one gram need time for all pairs but no memory.
* items whose normal form is shorter than q are no evidence and match nothing;
  repeated items are reported once per item id; null items are ignored.
* empty documents or benchmark: empty result, or all clean.
* extra columns are not read; ``clean`` keeps them untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.llm.grams import gram_hash
from tickforge.llm.store import discard, stored

Q, EDITS = 12, 0.05
SLICE_BYTES, BLOCK, RUN = 16_000_000, 4_000_000, 2_000_000
_TABLE_BITS = 22
_FOLD = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], dtype=np.uint8)


def normal_form(text: str | None) -> np.ndarray:
    """Bytes of the normal form, without a space at either end."""
    raw = _FOLD[np.frombuffer((text or "").lower().encode("utf-8", "replace"), dtype=np.uint8)]
    space = raw == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    out = raw[keep]
    if len(out) and out[-1] == 32:
        out = out[:-1]
    return out[1:] if len(out) and out[0] == 32 else out


def edit_budget(m: int, q: int = Q, rate: float = EDITS) -> int:
    """Permitted edits: ``rate`` of the length, less where the bound would fall below 1."""
    return max(0, min(int(rate * m), (m - q) // q))


def banded_distance(item: np.ndarray, text: np.ndarray, shift: int, width: int, most: int) -> int:
    """Least edits between ``item`` and a stretch of ``text`` that starts within
    ``width`` of ``shift``; rows are aligned inside that band only. ``most``+1 if more."""
    far, lanes = most + 1, 2 * width + 1
    lane = np.arange(lanes)
    row = np.zeros(lanes, dtype=np.int32)  # any start is free
    row[(shift - width + lane < 0) | (shift - width + lane > len(text))] = far
    for i, c in enumerate(item):
        at = shift - width + i + lane  # text position consumed by a diagonal step
        inside = (at >= 0) & (at < len(text))
        step = np.full(lanes, far, dtype=np.int32)
        step[inside] = row[inside] + (text[at[inside]] != c)
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)  # item character left out
        # extra text characters run along the lane: least over earlier lanes plus distance
        row = np.minimum(np.minimum.accumulate(step - lane) + lane, far)
        if row.min() > most:
            return far
    return int(row.min())


class Matcher:
    """The q-grams of one slice of the benchmark."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, rate: float = EDITS):
        self.q = q
        forms = [(i, normal_form(t)) for i, t in items]
        self.items = [(i, f) for i, f in forms if len(f) >= q]
        grams = [gram_hash(f, q) for _, f in self.items]
        hashes = np.concatenate(grams or [np.zeros(0, np.uint64)])
        number = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams] or [np.zeros(0, np.int64)])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.number, self.place = hashes[order], number[order], place[order]
        self.table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.table[self.hashes >> np.uint64(64 - _TABLE_BITS)] = True
        self.length = np.array([len(f) for _, f in self.items], dtype=np.int64)
        self.budget = np.array([edit_budget(m, q, rate) for m in self.length], dtype=np.int64)
        self.bound = self.length + 1 - q - self.budget * q

    def hits(self, data: np.ndarray, run: int = RUN) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item, diagonal) of every shared q-gram, in runs of at most ``run`` (or of
        the items that share a single gram of the text)."""
        grams = gram_hash(data, self.q)
        at = np.flatnonzero(self.table[grams >> np.uint64(64 - _TABLE_BITS)])
        found = grams[at]
        low = np.searchsorted(self.hashes, found, "left")
        n = np.searchsorted(self.hashes, found, "right") - low
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        ends = np.cumsum(n)
        first = 0
        while first < len(at):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + run, "right")))
            m = n[first:last]
            which = np.repeat(low[first:last] - np.cumsum(m) + m, m) + np.arange(m.sum())
            yield self.number[which], np.repeat(at[first:last], m) - self.place[which]
            first = last

    def bands(self, data: np.ndarray, run: int = RUN) -> np.ndarray:
        """(item, first diagonal) of every band that meets the item's bound."""
        wide = (len(data) + int(self.length.max(initial=0))) * 2 + 4
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for item, diagonal in self.hits(data, run):
            band = diagonal // np.maximum(self.budget[item], 1)
            new, n = np.unique(np.concatenate([item * wide + b + wide // 2 for b in (band, band - 1)]), return_counts=True)
            keys, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, n]), len(keys)).astype(np.int64)
        item, band = keys // wide, keys % wide - wide // 2
        met = counts >= self.bound[item]
        return np.stack([item[met], band[met] * np.maximum(self.budget[item[met]], 1)], axis=1)

    def matches(self, block: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
        """(document number, item id, edits) over documents laid out in ``block``."""
        best: dict[tuple[int, int], int] = {}
        for item, diagonal in self.bands(block):
            name, form = self.items[item]
            k, m = int(self.budget[item]), len(form)
            doc = int(np.searchsorted(starts, max(diagonal, 0) + min(m // 2, max(0, m - 1)), "right")) - 1
            if doc < 0 or best.get((doc, name)) == 0:
                continue
            lo, hi = max(diagonal - k, starts[doc]), min(diagonal + 2 * k + m + k + 1, ends[doc])
            stretch = block[lo:hi]
            if form.tobytes() in stretch.tobytes():
                best[doc, name] = 0
                continue
            edits = banded_distance(form, stretch, int(diagonal + k - lo), 2 * k + 1, k)
            if edits <= k:
                best[doc, name] = min(edits, best.get((doc, name), edits))
        return [(doc, name, edits) for (doc, name), edits in sorted(best.items())]


def _blocks(texts: pd.Series, q: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents in normal form, laid out with zero bytes between them."""
    gap, held, size, first = np.zeros(q, dtype=np.uint8), [], 0, 0
    for i, t in enumerate(texts):
        held.append(normal_form(t))
        size += len(held[-1]) + q
        if size > BLOCK or i == len(texts) - 1:
            sizes = np.array([len(h) for h in held], dtype=np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes + q)[:-1]])
            yield first, np.concatenate([x for h in held for x in (h, gap)]), starts, starts + sizes
            held, size, first = [], 0, i + 1


def _slices(benchmark: DataFrame, item_col: str, text_col: str, slice_bytes: int) -> Iterator[list]:
    """The benchmark, read slice by slice; each slice holds about ``slice_bytes``."""
    rows = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("body")).where("body is not null")
    total = rows.agg(F.sum(F.octet_length("body")).alias("n")).first()["n"] or 0
    n = -(-int(total) // slice_bytes) or 1
    part = F.pmod(F.xxhash64("item", "body"), F.lit(n))
    for i in range(n):
        yield [(r["item"], r["body"]) for r in rows.where(part == i).collect()]


def _judge(matcher: Matcher, texts: pd.Series, items: list[list], edits: list) -> None:
    for first, block, starts, ends in _blocks(texts, matcher.q):
        for doc, name, e in matcher.matches(block, starts, ends):
            items[first + doc].append(name)
            held = edits[first + doc]
            edits[first + doc] = e if held is None else min(e, held)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", q: int = Q, rate: float = EDITS,
                  slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(id, contaminated, items, edits) per row: item ids found and the least edits."""
    spark = docs.sparkSession
    found = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("body"),
                        F.array().cast("array<long>").alias("items"), F.lit(None).cast("long").alias("edits"))
    for n, part in enumerate(_slices(benchmark, item_col, item_text_col, slice_bytes)):
        shared = spark.sparkContext.broadcast(part)

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            matcher = Matcher(shared.value, q, rate)
            for batch in batches:
                items = [list(x) for x in batch["items"]]
                edits = [None if pd.isna(e) else int(e) for e in batch["edits"]]
                _judge(matcher, batch["body"], items, edits)
                yield batch.assign(items=items, edits=pd.array(edits, "Int64"))

        before, found = found, (stored(found, "slice") if n else found)
        if n > 1:
            discard(held)
        held, found = found, found.mapInPandas(scan, before.schema)
    return found.select(F.col("key").alias(id_col), (F.size("items") > 0).alias("contaminated"),
                        F.array_sort(F.array_distinct("items")).alias("items"), "edits")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", q: int = Q, rate: float = EDITS,
          slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of ``docs`` that match no item, with all their columns."""
    spark, out = docs.sparkSession, docs
    for n, part in enumerate(_slices(benchmark, item_col, item_text_col, slice_bytes)):
        shared = spark.sparkContext.broadcast(part)

        def scan(batches, shared=shared):
            matcher = Matcher(shared.value, q, rate)
            for batch in batches:
                texts = batch.column(batch.schema.names.index(text_col)).to_pandas()
                items, edits = [[] for _ in range(len(texts))], [None] * len(texts)
                _judge(matcher, texts, items, edits)
                yield batch.filter(pa.array([not x for x in items], pa.bool_()))

        out = stored(out, "slice") if n else out
        if n > 1:
            discard(held)
        held, out = out, out.mapInArrow(scan, docs.schema)
    return out
