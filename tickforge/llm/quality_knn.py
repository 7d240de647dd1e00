"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

Texts become terms of two kinds, each of unit length: log counts of hashed byte
trigrams weighted by inverse document frequency, and frequencies of word forms
(case, symbols, end mark, length, same word as before). The terms are projected
on the leading eigenvectors of the sample's Gram matrix (latent semantic
analysis). The vectors of a bounded sample of labelled rows
are broadcast; every document's cosine with all of them is an exact product
computed in blocks, and the ``neighbours`` nearest vote with weights that grow
with their similarity.

The fitted sample is bounded by ``sample`` rows (the labelled rows with the
smallest id hashes): 4 bytes x ``dims`` x ``sample`` are broadcast, 2 MB by
default. Only the text enters a score.

Defined results
* null or empty text, or text under three bytes: no vector, score = the share of label 1.
* null ids are scored but never learnt from; rows that repeat a labelled id
  contribute one row each to the sample; null labels are ignored.
* ties in similarity: the neighbour that comes first in id-hash order votes.
* very long texts: whole; memory is one text and one block of products.
* no labels at all: every score is 0.5. Empty table: empty result.
* extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.llm.grams import word_bounds, word_hashes

TRIGRAMS, FORMS = 2048, 128
BINS, DIMS, SAMPLE, NEIGHBOURS, BLOCK = TRIGRAMS + FORMS, 64, 8192, 16, 512
THRESHOLD, SHARPNESS, FORM_WEIGHT = 0.3, 16.0, 2.0


def held_out(id_col: Column) -> Column:
    """Rows kept out of training: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _among(characters: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[ord(c) for c in characters]] = True
    return table


_SYMBOL, _END = _among("#*$%&|<>"), _among(".,!?;:")


def word_forms(data: np.ndarray) -> np.ndarray:
    """Form code of every word: repeats its predecessor, holds a symbol, starts in
    upper case, all upper case, ends in a mark, length class."""
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    hashes = word_hashes(data)
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    again = np.append(False, hashes[1:] == hashes[:-1])
    symbol = np.add.reduceat(_SYMBOL[data], starts, dtype=np.int64) > 0
    loud = (np.add.reduceat(upper, starts, dtype=np.int64) > 1) & (np.add.reduceat(lower, starts, dtype=np.int64) == 0)
    return (again + 2 * symbol + 4 * upper[starts] + 8 * loud + 16 * _END[data[ends - 1]]
            + 32 * np.digitize(ends - starts, [3, 6, 10]))


def term_counts(texts) -> np.ndarray:
    """Hashed byte trigrams, then word forms: one row of ``BINS`` counts per text."""
    out = np.zeros((len(texts), BINS), dtype=np.float32)
    for i, t in enumerate(texts):
        data = np.frombuffer((t or "").encode("utf-8", "replace"), dtype=np.uint8)
        b = data.astype(np.uint32)
        if len(b) >= 3:
            code = (b[:-2] | b[1:-1] << 8 | b[2:] << 16) * np.uint32(0x9E3779B1)
            out[i, :TRIGRAMS] = np.bincount(code >> np.uint32(21), minlength=TRIGRAMS)
            out[i, TRIGRAMS:] = np.bincount(word_forms(data), minlength=FORMS)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Both kinds of terms, each of unit length, forms times ``FORM_WEIGHT``."""
    grams = _unit(np.log1p(counts[:, :TRIGRAMS]) * idf)
    return np.concatenate([grams, FORM_WEIGHT * _unit(np.sqrt(counts[:, TRIGRAMS:]))], axis=1)


def nearest(similarity: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` greatest values of every row; of equal ones the first."""
    near = np.argpartition(-similarity, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(similarity, near, axis=1).min(axis=1)[:, None]
    tied = np.flatnonzero((similarity >= least).sum(axis=1) > k)
    for i in tied:
        above = np.flatnonzero(similarity[i] > least[i])
        near[i] = np.concatenate([above, np.flatnonzero(similarity[i] == least[i])[:k - len(above)]])
    return near


@dataclass
class Model:
    """What is broadcast: weights, projection, labelled vectors and votes."""
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    votes: np.ndarray
    prior: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return _unit(weighted(counts, self.idf) @ self.basis).astype(np.float32)

    def score(self, texts, neighbours: int, block: int = BLOCK) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not len(self.votes):
            return out
        k = min(neighbours, len(self.votes))
        for at in range(0, len(texts), block):
            counts = term_counts(texts[at:at + block])
            some = np.flatnonzero(counts.sum(axis=1) > 0)
            if not len(some):
                continue
            cosine = self.embed(counts[some]) @ self.vectors.T
            near = nearest(cosine, k)
            sim = np.take_along_axis(cosine, near, axis=1)
            weight = np.maximum(sim, 0.0).astype(np.float64) ** SHARPNESS + 1e-9
            out[at + some] = (weight * self.votes[near]).sum(axis=1) / weight.sum(axis=1)
        return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", sample: int = SAMPLE, dims: int = DIMS) -> Model:
    """Fit on at most ``sample`` labelled rows outside the held-out fold."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("mark"))
    marks = marks.where(F.col("id").isNotNull() & F.col("mark").isNotNull() & ~held_out(F.col("id")))
    chosen = marks.groupBy("id").agg(F.max("mark").alias("mark")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).join(F.broadcast(chosen), "id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = term_counts(batch["body"]).astype(np.uint32)
            yield pd.DataFrame({"id": batch["id"], "mark": batch["mark"], "counts": [c.tobytes() for c in counts]})

    id_type = docs.schema[id_col].dataType.simpleString()
    fitted = (rows.mapInPandas(count, f"id {id_type}, mark int, counts binary")
              .orderBy(F.xxhash64("id"), "id", "counts").limit(sample).collect())
    if not fitted:
        return Model(np.ones(TRIGRAMS, np.float32), np.zeros((BINS, dims), np.float32),
                     np.zeros((0, dims), np.float32), np.zeros(0), 0.5)
    counts = np.stack([np.frombuffer(r["counts"], dtype=np.uint32) for r in fitted]).astype(np.float32)
    votes = np.array([float(r["mark"] > 0) for r in fitted])
    held = (counts[:, :TRIGRAMS] > 0).sum(axis=0)
    idf = np.log((1 + len(counts)) / (1 + held)).astype(np.float32) + 1
    x = weighted(counts, idf)
    basis = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :dims].astype(np.float32)
    model = Model(idf, basis, np.zeros((0, dims), np.float32), votes, float(votes.mean()))
    some = counts.sum(axis=1) > 0
    model.vectors, model.votes = model.embed(counts[some]), votes[some]
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          neighbours: int = NEIGHBOURS, threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "score": shared.value.score(list(batch["body"]), neighbours)})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    scored = rows.mapInPandas(vote, f"id {id_type}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
