"""Exact removal of long repeated byte strings with a common-prefix interval tree.

A byte goes if a string of ``least`` bytes that covers it also starts anywhere
else in the corpus. The suffix array is sparse: it holds the suffixes that start
at anchors, the places whose ``SEED``-byte hash is the least of some window of
``least`` bytes. Anchors depend on the bytes alone, so two equal strings of
``least`` bytes hold an anchor at the same offset, with at least ``SEED`` bytes
after it; suffixes are dealt out by the hash of those bytes. What an anchor can
witness lies within its context: ``least - SEED`` bytes before, ``least`` after.

1. Anchors are summed by seed and context: those whose whole context occurs
   twice need no bytes, their context is repeated. One anchor per distinct
   context goes on, and only in seeds with several contexts.
2. Per seed the suffixes are sorted and their common prefixes scanned with a
   stack; each interval of the tree is a set of suffixes that share r bytes. In
   left order its members fall apart by their left extension: each part that
   shares l bytes with l + r >= ``least`` is a maximal repeat and all its
   occurrences go, not just neighbours.
3. Seeds with more than ``GROUP`` contexts walk the top of that tree as Spark
   jobs, one level per round, until every node fits a task.

Texts that occur more than once are one text here, so copies add no rows.

Defined results
* null or empty text: empty bytes, nothing removed; texts under ``least`` bytes
  lose nothing, even if they are copies.
* repeated rows are documents of their own: each is a copy of the other.
* null ids pass through and are judged like any other.
* very long texts: scanned in blocks of ``SCAN`` bytes.
* ties cannot arise: a byte is covered or not. Empty table: empty result.
* extra columns are not read. Equal texts are found by two 64-bit hashes; the spans
  of different texts are kept apart by the first of them alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tickforge.llm.grams import gram_hash, window_min
from tickforge.llm.store import discard, stored

LEAST, SEED, GROUP, SCAN = 400, 128, 65_536, 1_000_000
_LAST = (1 << 63) - 1
_PACK = 1 << 16  # a location is position * _PACK + bytes known after it


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def anchors(data: np.ndarray, least: int = LEAST, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Positions and seed hashes of the anchors of one text."""
    w, n = least - seed + 1, len(data)
    at, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for start in range(0, max(0, n - least + 1), SCAN):
        h = gram_hash(data[start:start + SCAN + least - 1], seed)
        low = window_min(h, w)
        # i is an anchor if it holds the least hash of a window that contains it
        edge = np.zeros(w - 1, np.uint64)
        found = np.flatnonzero(~window_min(~np.concatenate([edge, low, edge]), w) == h)
        at.append(found + start)
        hashes.append(h[found])
    places, first = np.unique(np.concatenate(at), return_index=True)
    return places, np.concatenate(hashes)[first]


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int((x != y).argmax())


def lcp_intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(first, last, depth) of every interval of suffixes that share ``depth`` bytes.

    ``lcp[i]`` is the common prefix of sorted suffixes i-1 and i; one stack scan.
    """
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        depth, left = (lcp[i] if i < len(lcp) else -1), i - 1
        while stack and stack[-1][1] > depth:
            left, top = stack.pop()
            yield left, i - 1, top
        if not stack or stack[-1][1] < depth:
            stack.append((left, depth))


class _RangeMin:
    """Least value of any range of an array, from a table of powers of two."""

    def __init__(self, x: np.ndarray):
        self.rows = [x]
        while 2 * (1 << len(self.rows) - 1) <= len(x):
            half, row = 1 << len(self.rows) - 1, self.rows[-1]
            self.rows.append(np.minimum(row[:-half], row[half:]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum over lo..hi, both included."""
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            m = level == k
            row = self.rows[k]
            out[m] = np.minimum(row[lo[m]], row[hi[m] - (1 << int(k)) + 1])
        return out


def _adjacent(strings: list[bytes]) -> np.ndarray:
    """Common prefixes of neighbours; the first entry is 0."""
    return np.array([0, *(common_prefix(a, b) for a, b in zip(strings, strings[1:], strict=False))], dtype=np.int64)


Node = tuple[np.ndarray, np.ndarray, int]


def suffix_nodes(lefts: list[bytes], rights: list[bytes], least: int = LEAST) -> Iterator[Node]:
    """(members, gaps, r) of every set of suffixes that share r bytes and may hold
    a repeat of ``least``: its members in left order, and the bytes that each
    shares with its predecessor before their anchors.

    ``lefts`` are read towards the start of the text.
    """
    n = len(lefts)
    if n < 2:
        return
    by_left = sorted(range(n), key=lefts.__getitem__)
    left_gap = _adjacent([lefts[i] for i in by_left])
    by_right = sorted(range(n), key=rights.__getitem__)
    right_gap = _adjacent([rights[i] for i in by_right])
    widest = int(left_gap.max())
    if widest + right_gap.max() < least:
        return
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    order, lowest, place = np.array(by_right), _RangeMin(left_gap), np.array(by_left)
    for first, last, depth in lcp_intervals(right_gap.tolist()):
        if depth + widest < least:
            continue
        if last - first == 1:
            pair = order[first:last + 1]
            reach = common_prefix(lefts[pair[0]], lefts[pair[1]])
            if reach + depth >= least:
                yield pair, np.array([0, reach]), depth
            continue
        ranks = np.sort(rank[order[first:last + 1]])
        yield place[ranks], np.append(0, lowest(ranks[:-1] + 1, ranks[1:])), depth


def maximal_repeats(nodes: Iterator[Node], least: int = LEAST, widest: bool = False
                    ) -> Iterator[tuple[np.ndarray, int | np.ndarray, int]]:
    """(members, l, r): every set that shares l bytes before and r after its anchors.

    In left order the members split where their left extensions differ; a part
    that cannot be extended as a whole is a maximal repeat with all occurrences.
    With ``widest`` one entry per node: its members that repeat at all, and of each
    the l of its widest repeat. That is the interval which is its parent in the tree
    of left extensions, as deep as the deeper of its two neighbouring gaps; all
    others that hold the member lie around it and reach less far.
    """
    for members, gaps, depth in nodes:
        if widest:
            reach = np.maximum(gaps, np.append(gaps[1:], 0))
            some = reach + depth >= least
            yield members[some], reach[some], depth
        elif len(members) == 2:
            if gaps[1] + depth >= least:
                yield members, int(gaps[1]), depth
        else:
            for first, last, reach in lcp_intervals(gaps.tolist()):
                if reach + depth >= least:
                    yield members[first:last + 1], reach, depth


def hull(nodes: Iterator[Node], n: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Per member the bytes before and after its anchor that its maximal repeats cover.

    All repeats of a member hold its anchor, so their union is one stretch.
    """
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for members, reach, depth in maximal_repeats(nodes, least, True):
        before[members] = np.maximum(before[members], reach)
        after[members] = np.maximum(after[members], depth)
    return before, after


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    body = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col), F.lit(_LAST)).cast("long").alias("doc"),
                       F.xxhash64(body).alias("h1"), F.xxhash64(F.lit("text"), body).alias("h2"), body.alias("body"))


_ANCHOR = ["seed", "ctx", "ref", "loc"]


def _frame(parts: list[tuple[np.ndarray, ...]], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({c: np.concatenate(x) for c, x in zip(names, zip(*parts, strict=True), strict=True)})


def anchor_rows(texts: DataFrame, least: int, seed: int) -> DataFrame:
    """(seed, ctx, ref, loc) of every anchor; a copy in the same task is skipped."""
    before = least - seed

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for batch in batches:
            out = []
            for ref, body in zip(batch["h1"], batch["body"], strict=True):
                raw = body.encode("utf-8", "surrogatepass")
                if len(raw) < least or ref in seen:
                    continue
                seen.add(ref)
                at, seeds = anchors(np.frombuffer(raw, np.uint8), least, seed)
                right = np.minimum(least, len(raw) - at)
                ctx = [_signed(xxhash.xxh3_64_intdigest(raw[max(0, p - before):p + least], min(p, before)))
                       for p in at.tolist()]
                out.append((seeds.view(np.int64), np.array(ctx, np.int64), np.full(len(at), ref), at * _PACK + right))
                if len(out) > 500:
                    yield _frame(out, _ANCHOR)
                    out = []
            if out:
                yield _frame(out, _ANCHOR)

    return texts.select("h1", "body").mapInPandas(scan, "seed long, ctx long, ref long, loc long")


def classify(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(full, edges): anchors (ctx, ref, loc) whose whole context occurs twice or
    more, and one anchor (seed, ref, loc) per context of each seed with several.

    Anchors are summed to one row per context before the shuffle, so neither a
    frequent context nor a frequent seed gathers its anchors in one task.
    """
    apart = (F.min("ref") != F.max("ref")) | (F.min("loc") != F.max("loc"))
    kinds = rows.groupBy("seed", "ctx").agg(F.min("ref").alias("ref"), F.min_by("loc", "ref").alias("loc"),
                                            apart.alias("full"))
    # a seed has several contexts if its least and its greatest differ: no seed is sorted
    several = kinds.groupBy("seed").agg(F.min("ctx").alias("lo"), F.max("ctx").alias("hi")).where("lo != hi")
    judged = kinds.join(several.select("seed", F.lit(True).alias("edge")).hint("merge"), "seed", "left")
    hits = stored(judged.withColumn("edge", F.coalesce("edge", F.lit(False))).where("full or edge"), "hits")
    repeated = hits.where("full").select("seed", "ctx").hint("merge")
    return rows.join(repeated, ["seed", "ctx"]).select("ctx", "ref", "loc"), hits.where("edge").select("seed", "ref", "loc")


def contexts(texts: DataFrame, owners: DataFrame, edges: DataFrame, before: int, whole: bool) -> DataFrame:
    """(seed, ref, pos, hl, hr, lhs, rhs) of every edge anchor; ``lhs`` is reversed.

    Unless ``whole``, a task sends the bytes of a side once per seed and hash.
    """
    wants = edges.groupBy("ref").agg(F.collect_list(F.struct("seed", "loc")).alias("wants"))
    wanted = owners.join(wants, owners["h1"] == wants["ref"]).select("doc", "h1", "wants")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent = set()
        for batch in batches:
            out = []
            for ref, body, wants in zip(batch["h1"], batch["body"], batch["wants"], strict=True):
                raw = body.encode("utf-8", "surrogatepass")
                for want in wants:
                    seed, (pos, right) = want["seed"], divmod(want["loc"], _PACK)
                    row = [seed, ref, pos]
                    sides = (raw[max(0, pos - before):pos][::-1], raw[pos:pos + right])
                    hashes = [_signed(xxhash.xxh3_64_intdigest(s)) for s in sides]
                    for side, (s, h) in enumerate(zip(sides, hashes, strict=True)):
                        new = whole or (seed, side, h) not in sent
                        sent.add((seed, side, h))
                        row.append(s if new else None)
                    out.append((*row[:3], *hashes, *row[3:]))
                if len(out) > 5000:
                    yield pd.DataFrame(out, columns=_CONTEXT)
                    out = []
            yield pd.DataFrame(out, columns=_CONTEXT)

    # Sorted by hash on both sides: what is wanted grows with the corpus, so it is never broadcast.
    found = texts.select("doc", "h1", "body").join(wanted.hint("merge"), ["doc", "h1"])
    return found.select("h1", "body", "wants").mapInPandas(
        cut, "seed long, ref long, pos long, hl long, hr long, lhs binary, rhs binary")


_CONTEXT = ["seed", "ref", "pos", "hl", "hr", "lhs", "rhs"]


Spans = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _group_spans(refs: np.ndarray, places: np.ndarray, hl: list[int], hr: list[int], lhs: list[bytes | None],
                 rhs: list[bytes | None], least: int, named: bool) -> Spans:
    """(repeat, ref, start, end) from the contexts of one node: one stretch per
    anchor, or if ``named`` one row per maximal repeat and occurrence."""
    left_of = {h: x for h, x in zip(hl, lhs, strict=True) if x is not None}
    right_of = {h: x for h, x in zip(hr, rhs, strict=True) if x is not None}
    seen = set(zip(hl, hr, strict=True))
    if len(seen) < len(hl):  # of equal contexts, the first
        first = {}
        for i, key in enumerate(zip(hl, hr, strict=True)):
            first.setdefault(key, i)
        keep = list(first.values())
        refs, places, hl, hr = refs[keep], places[keep], [hl[i] for i in keep], [hr[i] for i in keep]
    lefts, rights = [bytes(left_of[h]) for h in hl], [bytes(right_of[h]) for h in hr]
    nodes = suffix_nodes(lefts, rights, least)
    if named:
        out = []
        for members, k, r in maximal_repeats(nodes, least):
            one = members[0]
            name = _signed(xxhash.xxh3_64_intdigest(lefts[one][:k][::-1] + rights[one][:r]))
            out += [(name, refs[i], places[i] - k, places[i] + r) for i in members.tolist()]
        return tuple(np.array([row[c] for row in out], np.int64) for c in range(4))
    before, after = hull(nodes, len(lefts), least)
    some = after > 0
    return np.zeros(int(some.sum()), np.int64), refs[some], (places - before)[some], (places + after)[some]


def _spans(group: pd.DataFrame, least: int, named: bool) -> pd.DataFrame:
    """``_group_spans`` of a frame of contexts."""
    known = lambda c: [x if isinstance(x, bytes | bytearray) else None for x in group[c]]
    return _frame([_group_spans(group["ref"].to_numpy(), group["pos"].to_numpy(), group["hl"].tolist(),
                                group["hr"].tolist(), known("lhs"), known("rhs"), least, named)], _SPAN)


_SPAN = ["repeat", "ref", "start", "end"]


def solve(rows: DataFrame, least: int, named: bool) -> DataFrame:
    """(repeat, ref, start, end) of all rows of ``contexts``, seed by seed."""
    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[list]:
        """The columns of each seed's rows, in one piece."""
        held, now = None, None
        for batch in batches:
            seeds, refs, places = (batch[c].to_numpy() for c in ("seed", "ref", "pos"))
            lists = [batch[c].tolist() for c in ("hl", "hr", "lhs", "rhs")]
            edges = [0, *(np.flatnonzero(np.diff(seeds)) + 1).tolist(), len(batch)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                part = [refs[lo:hi], places[lo:hi], *(x[lo:hi] for x in lists)]
                if held is None or now != seeds[lo]:
                    if held is not None:
                        yield held
                    held, now = part, seeds[lo]
                else:
                    held = [np.concatenate([a, b]) if i < 2 else a + b for i, (a, b) in enumerate(zip(held, part, strict=True))]
        if held is not None:
            yield held

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for group in groups(batches):
            out.append(_group_spans(*group, least, named))
            size += len(out[-1][1])
            if size > 20_000 or len(out) > 5000:
                yield _frame(out, _SPAN)
                out, size = [], 0
        if out:
            yield _frame(out, _SPAN)

    return rows.repartition("seed").sortWithinPartitions("seed").select(*_CONTEXT).mapInPandas(
        run, "repeat long, ref long, start long, end long")


@F.pandas_udf(IntegerType())
def _lcp(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0 if x is None or y is None else common_prefix(bytes(x), bytes(y))
                      for x, y in zip(a, b, strict=True)], dtype="int32")


def solve_large(rows: DataFrame, least: int, group: int, named: bool) -> DataFrame:
    """As ``solve`` for seeds of any size: the top of the tree level by level.

    A node's depth is the common prefix of its least and greatest suffix, a
    partial aggregate. Members of a node agree far enough to the left exactly
    if they share ``least - depth`` bytes there; neighbours in left order inside
    such a part give the extent. Nodes that fit a task go to ``solve``.
    """
    out, state = None, rows.select("*", F.col("seed").alias("node"))
    while True:
        stats = state.groupBy("node").agg(F.count("*").alias("n"), F.min("rhs").alias("lo"), F.max("rhs").alias("hi"))
        stats = stored(stats.select("node", "n", _lcp("lo", "hi").alias("depth")), "nodes")
        fits = state.join(stats.where(F.col("n") <= group).select("node"), "node")
        some = solve(fits.select(F.col("node").alias("seed"), *_CONTEXT[1:]), least, named)
        out = some if out is None else out.unionByName(some)
        large = stats.where(F.col("n") > group)
        if large.isEmpty():
            return out
        top = stored(state.join(large.select("node", "depth"), "node"), "top")
        need = F.lit(least) - F.col("depth")
        part = top.where(F.octet_length("lhs") >= need).withColumn("agrees", F.substring(F.col("lhs"), F.lit(1), need))
        order = Window.partitionBy("node", "agrees").orderBy("lhs")
        near = part.select("*", F.lag("lhs").over(order).alias("prev"), F.lead("lhs").over(order).alias("next"))
        reach = near.where("prev is not null or next is not null").select(
            "node", "agrees", "ref", "pos", "depth", F.greatest(_lcp("lhs", "prev"), _lcp("lhs", "next")).alias("reach"))
        wide = reach.select(F.xxhash64("node", "agrees").alias("repeat"), "ref",
                            (F.col("pos") - F.col("reach")).alias("start"), (F.col("pos") + F.col("depth")).alias("end"))
        out = out.unionByName(stored(wide, "wide"))
        below = F.substring(F.col("rhs"), F.lit(1), F.col("depth") + 1)
        state = stored(top.where(F.octet_length("rhs") > F.col("depth"))
                       .select(*_CONTEXT, F.xxhash64("node", below).alias("node")), "level")


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spans of a text to the ranges that stay, and counts."""
    for batch in batches:
        out = []
        for ref, n, spans in batch[["ref", "n", "spans"]].itertuples(index=False):
            x = np.array([(s["start"], s["end"]) for s in spans], dtype=np.int64)
            x = x[np.argsort(x[:, 0], kind="stable")]
            ends = np.maximum.accumulate(x[:, 1])
            new = np.append(True, x[1:, 0] > ends[:-1])
            starts, stops = x[new, 0], ends[np.append(new[1:], True)]
            keep = np.stack([np.append(0, stops), np.append(starts, n)], axis=1)
            keep = keep[keep[:, 1] > keep[:, 0]]
            out.append((ref, int((stops - starts).sum()), len(starts),
                        [{"at": int(a), "len": int(b - a)} for a, b in keep]))
        yield pd.DataFrame(out, columns=["ref", "n_removed", "n_spans", "keep"])


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
                 seed: int = SEED, group: int = GROUP, named: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, owners, repeats): rows (doc, h1, h2, n); owners one row per distinct
    text (h1, h2, doc, copies, n); repeats (repeat, ref, start, end) between them.

    ``named``: every maximal repeat with all its occurrences, which share
    ``repeat``; else one covered stretch per anchor, which is all removal needs.
    """
    texts = _texts(docs, id_col, text_col)
    rows = stored(texts.select("doc", "h1", "h2", F.octet_length("body").cast("long").alias("n")), "texts")
    owners = stored(rows.groupBy("h1", "h2").agg(F.min("doc").alias("doc"), F.count("*").alias("copies"),
                                                 F.max("n").alias("n")), "owners")
    found = stored(anchor_rows(texts, least, seed), "anchors")
    full, edges = classify(found)
    pos = F.floor(F.col("loc") / _PACK)
    full = full.select(
        F.col("ctx").alias("repeat"), "ref", (pos - F.least(pos, F.lit(least - seed))).alias("start"),
        (pos + F.pmod("loc", F.lit(_PACK))).alias("end"))
    sizes = edges.groupBy("seed").agg(F.count("*").alias("size"))
    large = stored(sizes.where(F.col("size") > group).select("seed"), "large")
    owned = owners.select("doc", "h1")
    if large.isEmpty():
        spans = solve(contexts(texts, owned, edges, least - seed, False), least, named)
    else:
        few, many = edges.join(large, "seed", "left_anti"), edges.join(large, "seed", "left_semi")
        spans = solve(contexts(texts, owned, few, least - seed, False), least, named).unionByName(
            solve_large(stored(contexts(texts, owned, many, least - seed, True), "contexts"), least, group, named))
    repeats = stored(full.unionByName(spans), "repeats")
    discard(found)
    return rows, owners, repeats


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
                   seed: int = SEED, group: int = GROUP) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) per row; ``kept`` is binary."""
    rows, owners, repeats = find_repeats(docs, id_col, text_col, least, seed, group, named=False)
    single = owners.where("copies = 1").select(F.col("h1").alias("ref"), "doc", "n")
    spans = repeats.groupBy("ref").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    merged = single.join(spans, "ref").select("ref", "n", "spans").mapInPandas(
        _merge, "ref long, n_removed long, n_spans long, keep array<struct<at:long,len:long>>")
    part = single.select("ref", "doc").join(merged, "ref").select(
        "doc", F.col("ref").alias("h1"), "n_removed", "n_spans", "keep")
    copies = owners.where(f"copies > 1 and n >= {least}").select("h1", "h2")
    none = F.array().cast("array<struct<at:long,len:long>>")
    whole = rows.join(copies, ["h1", "h2"]).select(
        "doc", "h1", F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), none.alias("keep")).distinct()
    fate = stored(part.unionByName(whole), "fate")
    raw: Column = F.col("body").cast("binary")
    rest = F.array_join(F.transform("keep", lambda k: F.substring(
        raw, (k["at"] + 1).cast("int"), k["len"].cast("int")).cast("string")), "").cast("binary")
    joined = _texts(docs, id_col, text_col).select("id", "doc", "h1", "body").join(fate.hint("merge"), ["doc", "h1"], "left")
    return joined.select(F.col("id").alias(id_col), F.octet_length("body").cast("long").alias("n_bytes"),
                         F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
                         F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
                         F.when(F.col("keep").isNull(), raw).otherwise(rest).alias("kept"))
