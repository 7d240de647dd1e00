"""N-gram Jaccard self-join with count-vector R-trees.

A document is its set of distinct 5-word shingles (64-bit hashes). Equal sets
are one node. Two nodes can reach the threshold only if they share a shingle of
their prefixes (the first ``n - ceil(t*n) + 1`` shingles in any fixed order), so
prefix shingles make the cells of the search; shingles that are frequent come
last in the order, which keeps common passages out of the prefixes.

1. In each cell the node with the fewest rare shingles is the hub (a copy of it
   has more), and hub pairs of fitting size are verified exactly. One sorted
   pass over (shingle, node) rows finds all hubs. This joins groups of copies
   by stars: links grow with the rows, never with the square of a group.
2. Nodes that share a cell share a hub, so all remaining pairs lie among the
   members of one hub. Where a hub's members are not yet in one component, the
   members' count vectors (shingles hashed into ``GROUPS`` groups) are packed
   into an R-tree: the summed coordinate minima of two boxes, then of two
   points, bound the overlap, and pairs between components that survive are
   verified exactly. Large cells are split into blocks that meet pair by pair.
3. Components come from alternating stars over the verified links.

Defined results
* null or empty text, or no words: no shingles, linked with nothing.
* null ids sort after every id; a component of null ids only has a null id.
* rows that repeat an id share its node; each row is returned.
* very long texts: whole; memory is one set per side and one batch.
* empty table: empty result. Extra columns are not read; ``first_of_group``
  keeps them untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickforge.llm.components import components
from tickforge.llm.grams import shingles
from tickforge.llm.store import discard, stored

WORDS, PERCENT, GROUPS = 5, 80, 256
LEAF, BLOCK_ROWS, LEAVES_PER_SALT, SALTS = 32, 4096, 1024, 64
FREQUENT, MOST_FREQUENT = 64, 65_536
_LAST = (1 << 63) - 1
_REF = (1 << 48) - 1


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    return shingles(np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8), words)


def set_hashes(s: np.ndarray) -> tuple[int, int]:
    h1, h2 = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64)
    return int(h1), int(h2)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def count_vector(s: np.ndarray) -> np.ndarray:
    """Shingles per group: two bytes a group, four where a group has more than fit."""
    counts = np.bincount(s >> np.uint64(64 - 8), minlength=GROUPS)
    return counts.astype(np.uint16 if counts.max(initial=0) < 1 << 16 else np.uint32)


def read_vector(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * GROUPS else np.uint32)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _row_key(id_col: str, text_col: str) -> list:
    return [F.coalesce(F.col(id_col), F.lit(_LAST)).cast("long").alias("doc"),
            F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row")]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(*_row_key(id_col, text_col), F.col(text_col).alias("body"))


def _slices(texts: pd.Series, most: int = 16_000_000) -> Iterator[slice]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > most:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def signatures(keyed: DataFrame, words: int) -> DataFrame:
    """(doc, row, h1, h2, n, vec) per row, and (token, df) of locally frequent shingles."""
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _slices(batch["body"]):
                sets = [shingle_set(t, words) for t in batch["body"].iloc[part]]
                h1, h2 = zip(*map(set_hashes, sets), strict=True)
                yield pd.DataFrame({"doc": batch["doc"].iloc[part].to_numpy(),
                                    "row": batch["row"].iloc[part].to_numpy(), "h1": h1, "h2": h2,
                                    "n": [len(s) for s in sets], "vec": [count_vector(s).tobytes() for s in sets],
                                    "token": 0, "df": 0})
                tokens, df = np.unique(np.concatenate(sets), return_counts=True)
                often = df >= max(4, len(sets) // 1000)
                yield pd.DataFrame({"doc": None, "row": 0, "h1": 0, "h2": 0, "n": 0, "vec": None,
                                    "token": tokens[often].view(np.int64), "df": df[often]})

    return keyed.mapInPandas(sign, "doc long, row long, h1 long, h2 long, n int, vec binary, token long, df long")


def prefixes(keyed: DataFrame, frequent: np.ndarray, words: int, percent: int) -> DataFrame:
    """(token, salt, ref) of every prefix shingle of every node.

    ``ref`` orders nodes by their number of rare shingles, then by set hash;
    ``salt`` splits frequent shingles and is -1 for all others.
    """
    shared = keyed.sparkSession.sparkContext.broadcast(frequent)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often, seen = shared.value, set()
        for batch in batches:
            for part in _slices(batch["body"]):
                tokens, salts, refs = [], [], []
                for t in batch["body"].iloc[part]:
                    s = shingle_set(t, words)
                    h = set_hashes(s)
                    if not len(s) or h in seen:
                        continue
                    seen.add(h)
                    at = np.minimum(np.searchsorted(often, s), max(len(often) - 1, 0))
                    common = often[at] == s if len(often) else np.zeros(len(s), bool)
                    rare, p = int((~common).sum()), prefix_size(len(s), percent)
                    kept = np.concatenate([s[~common], s[common]])[:p]
                    ref = min(rare, 32_767) << 48 | h[0] & _REF
                    tokens.append(kept)
                    salts.append(np.where(np.arange(p) < rare, -1, ref % SALTS))
                    refs.append(np.full(p, ref))
                if tokens:
                    yield pd.DataFrame({"token": np.concatenate(tokens).view(np.int64),
                                        "salt": np.concatenate(salts), "ref": np.concatenate(refs)})

    return keyed.mapInPandas(emit, "token long, salt int, ref long")


def hub_pairs(rows: DataFrame) -> DataFrame:
    """Distinct (a, b) set references: every node a with the hub b of each of its cells.

    Cells of rare shingles find their hub in one sorted pass. Cells of frequent
    shingles are split by salt in that pass; their hub is the least reference of
    the shingle, a partially aggregated table of at most ``MOST_FREQUENT`` rows.
    """
    cell = Window.partitionBy("token", "salt").orderBy("ref").rowsBetween(Window.unboundedPreceding, 0)
    first = stored(rows.withColumn("hub", F.first("ref").over(cell)).where("ref != hub or salt >= 0"), "hubs")
    often = first.where("salt >= 0").select("token", "ref")
    least = often.groupBy("token").agg(F.min("ref").alias("hub"))
    both = (first.where("salt < 0").select("ref", "hub")
            .unionByName(often.join(F.broadcast(least), "token").where("ref != hub").select("ref", "hub")))
    mask = F.lit(_REF)
    pairs = stored(both.distinct().select(F.col("ref").bitwiseAND(mask).alias("a"),
                                          F.col("hub").bitwiseAND(mask).alias("b")), "pairs")
    discard(first)
    return pairs


def verify(keyed: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (leaf, hub) of documents whose sets reach the threshold.

    The sets of the leaves travel to their hub; a hub with many leaves is
    copied to several tasks that share them. The documents wanted grow with the
    corpus, so they are sort-merge joined, never broadcast.
    """
    salts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / LEAVES_PER_SALT).cast("int").alias("salts"))
    leaves = pairs.join(salts, "hub").select(
        F.col("leaf").alias("doc"), "hub", F.pmod(F.xxhash64("leaf"), F.col("salts")).cast("int").alias("salt"),
        F.lit(1).alias("leaf"))
    hubs = salts.select(F.col("hub").alias("doc"), "hub",
                        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("leaf"))
    wants = leaves.unionByName(hubs).groupBy("doc").agg(F.collect_list(F.struct("hub", "salt", "leaf")).alias("wants"))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _slices(batch["body"], 4_000_000):
                out = [(w["hub"], w["salt"], w["leaf"], doc, s)
                       for doc, body, wants in batch.iloc[part].itertuples(index=False)
                       for s in [shingle_set(body, words).tobytes()] for w in wants]
                yield pd.DataFrame(out, columns=["hub", "salt", "leaf", "doc", "items"])

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, centre = None, []
        for batch in batches:
            found = []
            for hub, salt, leaf, doc, items in batch.itertuples(index=False):
                s = np.frombuffer(items, dtype=np.uint64)
                if (hub, salt) != cell:
                    cell, centre = (hub, salt), []
                if not leaf:
                    centre.append(s)
                elif any(similar(s, c, percent) for c in centre):
                    found.append((doc, hub))
            yield pd.DataFrame(found, columns=["u", "v"])

    sets = keyed.join(wants.hint("merge"), "doc").select("doc", "body", "wants").mapInPandas(
        send, "hub long, salt int, leaf int, doc long, items binary")
    return (sets.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "leaf")
            .mapInPandas(test, "u long, v long"))


class RTree:
    """Count vectors packed into boxes by recursive median splits."""

    def __init__(self, size: np.ndarray, points: np.ndarray):
        self.size, self.points, self.leaves = size, points, []
        self._pack(np.arange(len(size)))
        self.high = np.stack([points[x].max(axis=0) for x in self.leaves])
        self.small = np.array([size[x].min() for x in self.leaves])
        self.large = np.array([size[x].max() for x in self.leaves])

    def _pack(self, rows: np.ndarray) -> None:
        if len(rows) <= LEAF:
            self.leaves.append(rows)
            return
        sizes = self.size[rows]
        if int(sizes.max()) * 4 > int(sizes.min()) * 5:  # sizes first: they bound the overlap best
            key = sizes
        else:
            box = self.points[rows]
            key = box[:, int(np.argmax(box.max(axis=0).astype(np.int64) - box.min(axis=0)))]
        order = rows[np.argsort(key, kind="stable")]
        self._pack(order[:len(order) // 2])
        self._pack(order[len(order) // 2:])

    def join(self, other: RTree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs whose bound permits the threshold; overlap >= p/(100+p) * (a+b)."""
        for i, rows in enumerate(self.leaves):
            over = np.minimum(self.high[i], other.high).sum(axis=1, dtype=np.int64)
            fits = (100 + percent) * over >= percent * (self.small[i] + other.small)
            fits &= (100 * self.large[i] >= percent * other.small) & (100 * other.large >= percent * self.small[i])
            for j in np.flatnonzero(fits):
                cols = other.leaves[j]
                over = np.minimum(self.points[rows][:, None], other.points[cols][None]).sum(axis=2, dtype=np.int64)
                a, b = self.size[rows][:, None], other.size[cols][None]
                near = ((100 + percent) * over >= percent * (a + b)) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
                x, y = np.nonzero(near)
                yield rows[x], cols[y]


def _block_pairs(cell: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Candidate pairs between components of one cell block."""
    doc, label = cell["doc"].to_numpy(), cell["label"].to_numpy()
    size = cell["n"].to_numpy(np.int64)
    points = np.stack([read_vector(v).astype(np.uint32) for v in cell["vec"]])
    side = cell["side"].to_numpy()
    first, second = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    if not len(first) or not len(second):
        return pd.DataFrame({"leaf": [], "hub": []}, dtype=np.int64)
    a = RTree(size[first], points[first])
    b = a if np.array_equal(first, second) else RTree(size[second], points[second])
    out = []
    for x, y in a.join(b, percent):
        x, y = first[x], second[y]
        new = label[x] != label[y]
        if a is b:
            new &= doc[x] > doc[y]
        out.append(np.stack([np.maximum(doc[x[new]], doc[y[new]]), np.minimum(doc[x[new]], doc[y[new]])]))
    leaf, hub = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
    return pd.DataFrame({"leaf": leaf, "hub": hub}).drop_duplicates()


def cell_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of every cell: rows (cell, blocks, doc, label, n, vec), all
    pairs bounded; a cell of several blocks meets block by block."""
    own = members.withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                           F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0)
                           .otherwise(1).alias("side"), "doc", "label", "n", "vec")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            key = list(zip(held["cell"], held["i"], held["j"], strict=True))
            cuts = [n for n in range(1, len(key)) if key[n] != key[n - 1]]
            for lo, hi in zip([0, *cuts[:-1]], cuts, strict=False):
                yield _block_pairs(held.iloc[lo:hi], percent)
            held = held.iloc[cuts[-1]:].reset_index(drop=True) if cuts else held
        if held is not None and len(held):
            yield _block_pairs(held, percent)

    return (spread.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
            .mapInPandas(search, "leaf long, hub long").distinct())


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
         percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, reps, links): rows (doc, row, h1, h2, n), ``row`` the hash of the text; reps (h1, h2, rep, n, vec), one
    node per distinct set; links (node, root) of the verified similarity graph."""
    keyed = _keyed(docs, id_col, text_col)
    signed = stored(signatures(keyed, words), "signatures")
    rows = signed.where("doc is not null")
    top = (signed.where("df > 0").groupBy("token").agg(F.sum("df").alias("df")).where(F.col("df") >= FREQUENT)
           .orderBy(F.desc("df"), "token").limit(MOST_FREQUENT).collect())
    frequent = np.sort(np.array([r["token"] for r in top], dtype=np.int64).view(np.uint64))
    reps = stored(rows.where("n > 0").groupBy("h1", "h2").agg(
        F.min("doc").alias("rep"), F.first("n").alias("n"), F.first("vec").alias("vec")), "reps")
    nodes = reps.select(F.col("h1").bitwiseAND(F.lit(_REF)).alias("ref"), "rep", "n")
    pairs = hub_pairs(prefixes(keyed, frequent, words, percent))
    named = (pairs.join(nodes.select(F.col("ref").alias("a"), F.col("rep").alias("leaf"), F.col("n").alias("n_leaf")), "a")
             .join(nodes.select(F.col("ref").alias("b"), F.col("rep").alias("hub"), F.col("n").alias("n_hub")), "b"))
    named = stored(named.select("leaf", "hub", "n_leaf", "n_hub"), "named")
    fits = (100 * F.least("n_leaf", "n_hub") >= percent * F.greatest("n_leaf", "n_hub")) & (F.col("leaf") != F.col("hub"))
    stars = stored(verify(keyed, named.where(fits).select("leaf", "hub").distinct(), words, percent), "stars")
    first = components(stars)
    label = first.select(F.col("node").alias("leaf"), "root")
    members = (named.where("leaf != hub").select("leaf", "hub").distinct().join(label, "leaf", "left")
               .select(F.col("hub").alias("cell"), F.col("leaf").alias("doc"), F.coalesce("root", "leaf").alias("label")))
    members = stored(members, "members")
    mixed = (members.groupBy("cell").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"))
             .where("lo < hi").select("cell", F.ceil(F.col("size") / BLOCK_ROWS).cast("int").alias("blocks")))
    shape = reps.groupBy(F.col("rep").alias("doc")).agg(F.collect_list(F.struct("n", "vec")).alias("shapes"))
    shaped = (members.join(mixed, "cell").join(shape, "doc")
              .select("cell", "blocks", "doc", "label", F.inline("shapes")))
    candidates = stored(cell_pairs(shaped, percent), "candidates")
    rest = stored(verify(keyed, candidates, words, percent), "rest")
    links = components(stars.unionByName(rest))
    for done in (pairs, named, members, candidates):
        discard(done)
    return rows, reps.select("h1", "h2", "rep"), links


def _labelled(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    rows, reps, links = join(docs, id_col, text_col, words, percent)
    named = (rows.select("doc", "row", "h1", "h2", "n").join(reps, ["h1", "h2"], "left")
             .join(links.select(F.col("node").alias("rep"), "root"), "rep", "left"))
    return named.select("doc", "row", "n", F.coalesce("root", "rep", "doc").alias("component"))


def component_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                  percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) per row."""
    back = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    return _labelled(docs, id_col, text_col, words, percent).select(
        back("doc").alias(id_col), F.col("n").cast("long").alias("n_shingles"), back("component").alias("component_id"))


def first_of_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                   percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose id is the least of their component, with all columns.

    A row that repeats both id and text of another stays or goes with it.
    """
    gone = _labelled(docs, id_col, text_col, words, percent).where("doc != component")
    gone = stored(gone.select(F.col("doc").alias("_doc"), F.col("row").alias("_row")).distinct(), "gone")
    doc, row = _row_key(id_col, text_col)
    return docs.join(gone, (doc == F.col("_doc")) & (row == F.col("_row")), "left_anti")
