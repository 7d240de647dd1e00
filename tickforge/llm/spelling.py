"""Spelling variants: words one edit apart, grouped under their frequent form.

1. Word occurrences are counted, per task first. A word of the vocabulary has at
   least ``least_length`` code points and ``least_count`` occurrences.
2. One edit leaves either the first half of a word or the second untouched. So
   every word goes to the block of its first two code points and to that of its
   last two, and is searched there: the half that holds them is matched exactly in
   a bidirectional FM-index of the block, then the match is extended across the
   other half, allowing one error. The second search leaves out what the first
   finds, so every near word is found once.
3. A word's form is its most frequent near word, if that is at least ``factor``
   times as frequent; roots are found by pointer doubling.

There are at most 90 x 90 pairs of code points at either end, so their counts fit
the driver. Small ones share a block; one with more than ``block`` words is dealt
out over several blocks and its words are searched in each, streaming past the
index, so a block never holds more than ``block`` words.

Defined results
* null or empty text: no words; a null id reads as the empty string in the check
  number that decides whether an occurrence is damaged.
* repeated rows are documents of their own. Empty table: empty result.
* very long texts and words: a text is one task's; a word is matched in as many
  rounds as it has letters.
* ties between forms go to the least word in code point order.
* extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.llm.fm_index import Vocabulary
from tickforge.llm.store import discard, stored

LEAST_LENGTH, LEAST_COUNT, FACTOR, BLOCK = 5, 3, 2, 40_000
#: Letters of a run after A-Z are lower-cased; one in 97 occurrences is damaged.
RUN = re.compile("[a-zÀ-ÿ]+")
DAMAGE = 97
_BATCH = 8_000


def damaged(doc_id: str, run: str, crc: int | None = None) -> str:
    """``run`` without one code point if its check number says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode()) if crc is None else crc
    if h % DAMAGE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _frame(rows: Iterable[tuple], names: list[str]) -> pd.DataFrame:
    """Python objects as they are: pandas' own string columns may come in several pieces."""
    return pd.DataFrame(list(rows), columns=names, dtype=object)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                least_length: int = LEAST_LENGTH, flush: int = 200_000) -> DataFrame:
    """(word, n) of every word of at least ``least_length`` code points; a task
    sends its counts on whenever it holds over ``flush`` words."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch["id"], batch["body"], strict=True):
                here = zlib.crc32(f"{doc}:".encode())
                # bytes.lower() changes A-Z only
                for run, n in Counter(RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode(
                        "utf-8", "surrogatepass"))).items():
                    word = damaged(doc, run, zlib.crc32(run.encode(), here))
                    if len(word) >= least_length:
                        total[word] += n
                if len(total) > flush:
                    yield _frame(total.items(), ["word", "n"])
                    total.clear()
        yield _frame(total.items(), ["word", "n"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.col(text_col).alias("body")).where("body is not null")
    return rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def blocks(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(block, side, word, n, is_text, is_pattern): who is indexed and searched where.

    ``side`` 0 compares by the first two code points, 1 by the last two.
    """
    spark = words.sparkSession
    ends = words.select("word", "n", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.substring("word", 1, 2).alias("end")),
        F.struct(F.lit(1).alias("side"), F.substring("word", -2, 2).alias("end")))).alias("e")).select("word", "n", "e.*")
    # at most 2 x 90 x 90 rows, as letters come from a fixed alphabet of 90
    sizes = sorted(ends.groupBy("side", "end").agg(F.count(F.lit(1)).alias("c")).collect())
    plan, number, filled, last = [], -1, block, None
    for side, end, c in sizes:
        parts = -(-c // block)
        if parts > 1 or side != last or filled + c > block:
            number, filled = number + 1, 0
        plan.append((side, end, number, parts))
        filled = block if parts > 1 else filled + c
        number, last = number + parts - 1, side
    places = spark.createDataFrame(plan, "side int, end string, first int, parts int")
    dealt = ends.join(F.broadcast(places), ["side", "end"]).withColumn(
        "own", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    out = dealt.select("side", "word", "n", "first", "own",
                       F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return out.select((F.col("first") + F.col("part")).alias("block"), "side", "word", "n",
                      (F.col("part") == F.col("own")).alias("is_text")).repartitionByRange(max(1, number + 1), "block")


def _search(index: Vocabulary, words: list[bytes], counts: list[int], side: int,
            patterns: list[bytes]) -> Iterator[tuple[str, int, int, str]]:
    """(pattern, near words, count of the best, best) of the patterns with near words."""
    halves = [len(p) // 2 for p in patterns]
    if side == 0:
        who, found = index.one_error([b"\0" + p[:h] for p, h in zip(patterns, halves, strict=True)],
                                     [p[h:] for p, h in zip(patterns, halves, strict=True)], True)
    else:
        who, found = index.one_error([p[h:] + b"\0" for p, h in zip(patterns, halves, strict=True)],
                                     [p[:h] for p, h in zip(patterns, halves, strict=True)], False)
    best: dict[int, tuple] = {}
    for i, j in zip(who.tolist(), found.tolist(), strict=True):
        word = words[j]
        if side and word.startswith(patterns[i][:halves[i]]):
            continue  # the other search finds it
        n, key = best.get(i, (0, None))
        new = (-counts[j], word)
        best[i] = (n + 1, new if key is None or new < key else key)
    for i, (n, (count, word)) in best.items():
        yield patterns[i].decode("latin-1"), n, -count, word.decode("latin-1")


def near_words(rows: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) from the rows of ``blocks``, a row per block."""
    schema = "word string, n_near long, best_n long, best string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, words, counts, waiting, index = None, [], [], [], None

        def flush() -> Iterator[pd.DataFrame]:
            for lo in range(0, len(waiting), _BATCH):
                yield _frame(_search(index, words, counts, key[1], waiting[lo:lo + _BATCH]), names)
            waiting.clear()

        for batch in batches:
            for block, side, word, n, is_text in batch.itertuples(index=False):
                if key != (block, side):
                    if waiting:
                        index = index or Vocabulary(words)
                        yield from flush()
                    key, words, counts, index = (block, side), [], [], None
                raw = word.encode("latin-1")
                if is_text:  # sorted before the rows that are only searched for
                    words.append(raw)
                    counts.append(n)
                waiting.append(raw)
                if not is_text and len(waiting) >= _BATCH and words:
                    index = index or Vocabulary(words)
                    yield from flush()
        if waiting:
            index = index or Vocabulary(words)
            yield from flush()

    return rows.sortWithinPartitions("block", F.desc("is_text")).select(
        "block", "side", "word", "n", "is_text").mapInPandas(run, schema)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form, by pointer doubling. Counts at
    least double along a chain, so rounds grow as log log of the greatest count."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = now.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        new = stored(step, "roots")
        discard(now)
        now = new.select("word", "root")
        if new.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
             least_count: int = LEAST_COUNT, factor: int = FACTOR, block: int = BLOCK) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the vocabulary."""
    if least_length < 4:
        raise ValueError("both halves of a word need two code points")
    words = stored(word_counts(docs, id_col, text_col, least_length).where(F.col("n") >= least_count), "words")
    found = near_words(blocks(words, block)).groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b"))
    known = words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("b.best").alias("best"),
        (-F.col("b.m")).alias("best_n"))
    takes = F.col("best_n") >= factor * F.col("n")
    table = stored(known.select("word", "n", "n_near", F.when(takes, F.col("best")).alias("form"),
                                F.when(takes, F.col("best_n")).alias("form_n")), "forms")
    ends = roots(table.where("form is not null"))
    return table.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
