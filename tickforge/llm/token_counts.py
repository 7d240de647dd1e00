"""Exact token counts, huge texts in overlapping chunks that are resynchronised.

A text up to ``chunk`` characters is encoded whole. A longer one is encoded in
chunks that overlap; two neighbours are spliced at a position where both have a
token boundary *and* which is provably stable: a space after a non-space, while
no piece of the vocabulary holds a space mark after another character (checked
when the model is loaded). No merge can cross such a position, so what stands
left or right of it cannot change the tokens on the other side. If an overlap
holds no such position it is doubled, in the end up to the whole text. Models
for which the proof fails are always encoded whole.

Defined results
* null or empty text: 0 bytes, 0 tokens, not over the limit.
* null ids pass through; repeated rows are counted row by row.
* very long texts: memory is one text and one chunk's pieces.
* empty table: empty result. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP, LIMIT = 32_768, 512, 4096
_MARK = "▁"
_LOADED: dict[str, object] = {}


class PieceCounter:
    """Counts of a sentencepiece model as ``encode`` gives them, nothing added."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        self.provable = self._provable(path)

    @staticmethod
    def _provable(path: str) -> bool:
        from sentencepiece import sentencepiece_model_pb2 as pb
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, trainer = model.normalizer_spec, model.trainer_spec
        kind = pb.ModelProto.SentencePiece
        plain = all(p.type != kind.USER_DEFINED and (p.type != kind.NORMAL or _MARK not in p.piece.lstrip(_MARK))
                    for p in model.pieces)
        return (plain and not norm.precompiled_charsmap and not norm.remove_extra_whitespaces
                and norm.escape_whitespaces and not trainer.treat_whitespace_as_suffix
                and trainer.model_type == pb.TrainerSpec.BPE)

    def _starts(self, text: str) -> list[int]:
        """Character offset at which each token of ``text`` begins."""
        at, out = 0, []
        for p in self.sp.encode(text, return_type="proto").pieces:
            out.append(at)
            at += len(p.surface)
        return out if at == len(text) else []

    @staticmethod
    def _stable(text: str, p: int) -> bool:
        return text[p] == " " and text[p - 1] not in (" ", _MARK)

    def _splice(self, text: str, a0: int, a: set[int], b0: int, b: set[int], end: int) -> int | None:
        """The first stable position in (b0, end) where both chunks have a boundary."""
        for p in range(b0 + 1, end):
            if self._stable(text, p) and p - a0 in a and p - b0 in b:
                return p
        return None

    def count_long(self, text: str) -> int:
        total, counted, a0, size = 0, 0, 0, self.chunk
        starts = self._starts(text[:size])
        if not starts:
            return len(self.sp.encode(text))
        while a0 + size < len(text):
            end, overlap, at = a0 + size, min(self.overlap, self.chunk // 2), None
            while at is None and end - overlap > counted and overlap < size:
                b0 = end - overlap
                nxt = self._starts(text[b0:b0 + self.chunk + overlap])
                at = self._splice(text, a0, set(starts), b0, set(nxt), end) if nxt else None
                overlap *= 2
            if at is None:  # nothing to align on: grow this chunk and try behind it
                size *= 2
                starts = self._starts(text[a0:a0 + size])
                if not starts:
                    return len(self.sp.encode(text))
                continue
            total += sum(counted - a0 <= s < at - a0 for s in starts) if counted else sum(s < at - a0 for s in starts)
            size, counted, a0, starts = min(len(text) - b0, self.chunk + overlap // 2), at, b0, nxt
        return total + (sum(s >= counted - a0 for s in starts) if counted else len(starts))

    def count(self, texts: list[str]) -> list[int]:
        long = [self.provable and len(t) > self.chunk for t in texts]
        short = iter(self.sp.encode([t for t, x in zip(texts, long, strict=True) if not x], num_threads=1))
        return [self.count_long(t) if x else len(next(short)) for t, x in zip(texts, long, strict=True)]


class VocabularyCounter:
    """Counts of a ``tokenizers`` file, nothing added, no truncation or padding."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()

    def count(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tok.encode_batch(texts, add_special_tokens=False)]


def counter(path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
    key = f"{path}|{chunk}|{overlap}"
    if key not in _LOADED:
        _LOADED[key] = VocabularyCounter(path) if path.endswith(".json") else PieceCounter(path, chunk, overlap)
    return _LOADED[key]


def _slices(texts: pd.Series, most: int = 4_000_000) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size > most:
            yield held
            held, size = [], 0
    yield held


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row; no shuffle."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(model_path, chunk, overlap)
        for batch in batches:
            n = [x for part in _slices(batch["body"]) for x in (c.count(part) if part else [])]
            yield pd.DataFrame({"id": batch["id"], "n_bytes": batch["n_bytes"], "n_tokens": n})

    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(body).cast("long").alias("n_bytes"), body.alias("body"))
    counted = rows.mapInPandas(count, f"id {id_type}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens",
                          (F.col("n_tokens") > limit).alias("over_limit"))
