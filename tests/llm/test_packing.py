import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from tickforge.llm import packing


def check(plan_rows, totals, capacities):
    """Every token once, no overlap, every bin the smallest that holds its contents."""
    placed, bins, size = Counter(), defaultdict(list), {}
    for r in plan_rows:
        if r.bin_id is not None:
            placed[r.doc_id] += r.n_tokens
            bins[r.bin_id].append((r.bin_offset, r.n_tokens))
            assert size.setdefault(r.bin_id, r.bin_capacity) == r.bin_capacity
    assert placed == Counter({k: v for k, v in totals.items() if v})
    for b, held in bins.items():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert size[b] == min(c for c in capacities if c >= at)
    return size


def test_packing_of_random_lengths(spark):
    rng = random.Random(4)
    totals = {i: rng.choice([0, 1, 7, 7, 7, rng.randint(1, 40), rng.randint(30, 200)]) for i in range(700)}
    docs = spark.createDataFrame(list(totals.items()), "doc_id long, n int").repartition(5)
    size = check(packing.pack(docs, F.col("n"), capacities=(16, 32, 64)).collect(), totals, (16, 32, 64))
    assert sum(totals.values()) / sum(size.values()) > 0.95
    again = {(r.doc_id, r.piece): r.bin_id for r in packing.pack(docs.repartition(3), F.col("n"), capacities=(16, 32, 64)).collect()}
    assert again == {(r.doc_id, r.piece): r.bin_id for r in packing.pack(docs, F.col("n"), capacities=(16, 32, 64)).collect()}


def naive_best_fit(lengths, capacity):
    """One piece after the other, each to the fullest bin that still holds it."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            i = min(fits, key=lambda i: room[i])
            room[i] -= n
        else:
            room.append(capacity - n)
    return sorted(room)


def test_histogram_plan_is_best_fit_decreasing():
    rng = random.Random(9)
    for _ in range(60):
        lengths = [rng.randint(1, 50) for _ in range(rng.randint(1, 200))]
        plan = packing.Plan(Counter(lengths), (50,))
        assert sorted(50 - used for _, m, used, _ in plan.sizes for _ in range(m)) == naive_best_fit(lengths, 50)


def test_cheaper_lengths_are_opened_and_cut_down():
    plan = packing.Plan({10: 4}, (16, 64), cost=lambda c: c)
    assert [(m, used, c) for _, m, used, c in plan.sizes] == [(1, 40, 64)] or all(c == 16 for *_, c in plan.sizes)
    assert packing.Plan({3: 1}, (16, 64)).sizes == [(0, 1, 3, 16)]
    assert packing.Plan({}, (16,)).sizes == []


def test_odd_rows(odd, none):
    rows = packing.pack(odd, packing.word_count(F.col("text")), capacities=(64, 256)).collect()
    words = Counter()
    for r in odd.collect():
        words[r.doc_id] += len((r.text or "").split())
    check(rows, words, (64, 256))
    assert Counter(r.doc_id for r in rows if r.bin_id is None) == Counter([None, 1, 2, 3])
    assert packing.pack(none, packing.word_count(F.col("text"))).count() == 0


def test_sequences_hold_every_token_once_and_in_order(spark):
    import pytest
    rng = random.Random(5)
    texts = {i: " ".join(f"d{i}w{j}" for j in range(rng.choice([0, 1, 3, 9, 30, 75]))) for i in range(120)}
    rows = [*texts.items(), (None, "null id"), (500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    packed = packing.pack(docs, packing.word_count(F.col("text")), capacities=(16, 32))
    bins = packing.sequences(docs, packed, packing.words(F.col("text"))).collect()
    found = defaultdict(list)
    for b in bins:
        assert b.n_tokens == len(b.tokens) <= b.bin_capacity and b.boundaries[0] == 0
        for at, end, doc in zip(b.boundaries, [*b.boundaries[1:], b.n_tokens], b.ids, strict=True):
            found[doc].append(b.tokens[at:end])
    order = lambda part: int(part[0].partition("w")[2] or 0)
    assert {d: [w for p in (sorted(ps, key=order) if d is not None else ps) for w in p] for d, ps in found.items()} == {
        d: t.split() for d, t in rows if t}
    with pytest.raises(ValueError, match="repeated"):
        packing.sequences(docs.union(docs), packed, packing.words(F.col("text")))
    assert packing.sequences(docs.limit(0), packed.limit(0), packing.words(F.col("text"))).count() == 0
