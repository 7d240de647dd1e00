import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from tickforge.llm import hilbert as H


@pytest.mark.parametrize(("n", "bits"), [(1, 3), (2, 1), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours_and_every_cell_once(spark, n, bits):
    cells = list(itertools.product(range(1 << bits), repeat=n))
    names = [f"x{i}" for i in range(n)]
    df = spark.createDataFrame(cells, ", ".join(f"{c} int" for c in names))
    got = {r["h"]: r[:n] for r in df.select(*names, H.hilbert_index([F.col(c) for c in names], bits).alias("h")).collect()}
    assert sorted(got) == list(range(len(cells)))
    assert all(sum(abs(a - b) for a, b in zip(got[i], got[i + 1], strict=True)) == 1 for i in range(len(cells) - 1))


def brute(rows, shards, bits, law):
    """rows: (id, text, lang, source); (id, size, crc, shard, slot) of each."""
    size = [len((t or "").encode()) + 1 for _, t, _, _ in rows]
    crc = [zlib.crc32((t or "").encode()) for _, t, _, _ in rows]
    low = lambda v: (v is not None, v)
    values = [[r[2] for r in rows], [r[3] for r in rows], size]
    axes = [[sum(low(o) < low(v) for o in vs) * (1 << bits) // len(rows) for v in vs] for vs in values]
    curve = [curve_index([a[i] for a in axes], bits) for i in range(len(rows))]
    order = sorted(range(len(rows)), key=lambda i: (curve[i], low(rows[i][0]), size[i], crc[i]))
    out, before, total, slots = [], 0, sum(size), {}
    for pos, i in enumerate(order):
        s = pos * shards // len(rows) if law == "rows" else before * shards // total
        before += size[i]
        out.append((rows[i][0], size[i], crc[i], s, slots.setdefault(s, 0)))
        slots[s] += 1
    return out


def curve_index(x, bits):
    """Skilling's transform, bit by bit."""
    x, n = list(x), len(x)
    q = 1 << bits - 1
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & q - 1
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << bits - 1
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    h = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            h = h << 1 | ((v ^ t) >> b & 1)
    return h


ROWS = [(i, "w" * (i * 7 % 40), "ab"[i % 2], f"s{0 if i % 3 else i % 5}") for i in range(90)] + [
    (None, None, None, None), (None, "", "a", None), (3, "again", "a", "s0"), (3, "again", "a", "s0"),
    (200, "é" * 900, "b", "s1")]


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_match_brute_force(spark, law):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").repartition(5)
    got = H.shard_table(docs, shards=4, bits=2, law=law).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got), key=str) == sorted(
        brute(ROWS, 4, 2, law), key=str)
    assert {r.law for r in got} == {law}
    if law == "rows":
        counts = [sum(r.shard == k for r in got) for k in range(4)]
        assert max(counts) - min(counts) <= 1


def test_odd_rows(odd, none):
    rows = H.shard_table(odd, dims=("key", "size"), shards=8).collect()
    assert len(rows) == odd.count() and sorted(r.slot for r in rows).count(0) == 8
    assert H.shard_table(none, dims=("key", "size")).count() == 0


def test_a_third_of_equal_rows_is_cut(spark):
    docs = spark.createDataFrame([(7, "same", "a", "s")] * 40 + [(i, str(i), "a", "s") for i in range(80)],
                                 "doc_id long, text string, lang string, source string")
    rows = H.shard_table(docs, shards=8).collect()
    assert [sum(r.shard == k for r in rows) for k in range(8)] == [15] * 8
    assert all(sorted(r.slot for r in rows if r.shard == k) == list(range(15)) for k in range(8))


def test_files_are_narrow_in_every_dimension(spark, tmp_path):
    rows = [(i, "x" * (i * 13 % 600), "abcd"[i % 4], f"s{i * 7 % 16:02d}") for i in range(3200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    H.write_shards(docs, str(tmp_path / "out"), shards=8, files=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text, r.lang, r.source) for r in back.collect()) == sorted(rows)
    boxes = back.groupBy(F.input_file_name().alias("f")).agg(
        F.min("lang").alias("l0"), F.max("lang").alias("l1"), F.min("source").alias("s0"), F.max("source").alias("s1"),
        F.min(F.length("text")).alias("n0"), F.max(F.length("text")).alias("n1")).collect()
    assert len(boxes) >= 32
    share = lambda hit: sum(map(hit, boxes)) / len(boxes)
    assert share(lambda b: b.l0 <= "b" <= b.l1) < 0.6
    assert share(lambda b: b.s0 <= "s05" <= b.s1) < 0.6
    assert share(lambda b: b.n0 <= 40 <= b.n1) < 0.6
