import random

import numpy as np
from llm_brute import best_substring_edits
from tickforge.llm import decontaminate as dc

SF = "/root/testdata/sf0.001"


def edited(rng, text, edits):
    t = list(text)
    for _ in range(edits):
        i = rng.randrange(len(t))
        kind = rng.randrange(3)
        if kind == 0:
            t[i] = rng.choice("qxz")
        elif kind == 1:
            del t[i]
        else:
            t.insert(i, rng.choice("qxz"))
    return "".join(t)


def test_every_match_within_the_budget_is_found(spark):
    rng = random.Random(2)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()][:8]
    filler = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt "
    texts = []
    for n in range(60):
        i = rng.randrange(len(items))
        texts.append(filler * rng.randint(0, 3) + edited(rng, items[i][1], rng.choice([0, 1, 3, 6, 9, 14])) + " " + filler)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: set(r["items"]) for r in dc.contamination(
        docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    forms = {i: dc.normal_form(t).tobytes() for i, t in items}
    for d, t in enumerate(texts):
        body = dc.normal_form(t).tobytes()
        want = {i for i, f in forms.items() if best_substring_edits(f, body) <= dc.edit_budget(len(f))}
        assert got[d] == want, d


def test_banded_alignment_equals_full_alignment():
    rng = random.Random(6)
    for _ in range(80):
        item = "".join(rng.choice("abcd") for _ in range(rng.randint(20, 60)))
        text = "".join(rng.choice("abcd") for _ in range(7)) + edited(rng, item, rng.randint(0, 5)) + "dcba"
        a, b = (np.frombuffer(x.encode(), np.uint8) for x in (item, text))
        full = best_substring_edits(item.encode(), text.encode())
        assert min(dc.banded_distance(a, b, 7, 20, 6), 7) == min(full, 7)


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "A line of ten, a line of TEN!"), (1, "A line of ten, a line of TEN!"), (2, None),
                                   (3, ""), (4, "short"), (None, "beta")], "item_id long, text string")
    rows = dc.contamination(odd, bench).collect()
    assert sorted(str((r.doc_id, list(r["items"]))) for r in rows if r.contaminated) == ["(8, [1])"]
    left = dc.clean(odd, bench)
    assert left.columns == odd.columns and left.count() == odd.count() - 1
    assert dc.contamination(none, bench).count() == 0 and dc.clean(odd, bench.limit(0)).count() == odd.count()
    sliced = dc.contamination(odd, bench, slice_bytes=20).collect()
    assert sorted(map(str, sliced)) == sorted(map(str, rows))


def test_item_that_spans_two_documents_is_no_match(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, item[:30]), (2, item[30:]), (3, item.upper())], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {r.doc_id for r in dc.contamination(docs, bench).collect() if r.contaminated} == {3}


def test_five_percent_of_edits_are_found_at_every_length(spark):
    rng = random.Random(9)
    items, texts, want = [], [], {}
    for n, m in enumerate([24, 60, 61, 80, 100, 233, 394, 1000]):
        item = "".join(rng.choice("abcdefgh") for _ in range(m))
        items.append((n, item))
        for more in (0, 1):
            k = int(0.05 * m) + more
            t = list(item)
            for j in range(k):  # spread evenly: the fewest q-grams stay
                t[(2 * j + 1) * m // (2 * k)] = "z"
            want[len(texts)] = [] if more else [n]
            texts.append("lorem ipsum dolor " + "".join(t) + " sit amet")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id: list(r["items"]) for r in dc.contamination(docs, bench).collect()} == want
    assert sorted(r.doc_id for r in dc.clean(docs, bench).collect()) == [d for d in want if not want[d]]


def test_repetitive_text_needs_little_memory():
    import tracemalloc
    matcher = dc.Matcher([(1, "a" * 400), (2, "ab" * 150)])
    for text, want in (("a" * 1_000_000, {1: 0}), ("ba" * 200_000, {2: 0})):
        data = dc.normal_form(text)
        tracemalloc.start()
        found = matcher.matches(data, np.array([0]), np.array([len(data)]))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert {i: e for _, i, e in found} == want and most < 500_000_000


def test_bands_do_not_depend_on_runs():
    rng = random.Random(4)
    items = [(i, "".join(rng.choice("ab ") for _ in range(rng.randint(20, 90)))) for i in range(12)]
    matcher = dc.Matcher(items, q=4)
    filler = lambda: "".join(rng.choice("ab ") for _ in range(300))
    data = dc.normal_form("".join(filler() + t for _, t in items) + filler())
    whole = matcher.bands(data)
    assert len(whole) and all(np.array_equal(whole, matcher.bands(data, run)) for run in (1, 7, 500))
