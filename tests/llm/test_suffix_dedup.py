import random
from collections import Counter

import pytest
from llm_brute import without_repeats
from tickforge.llm import suffix_dedup as sd


def pasted(seed=5):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abc") for _ in range(rng.randint(30, 200))) for _ in range(6)]
    out = [None, "", "a" * 100, "ab" * 80, "ab" * 80, "b" * 30, "b" * 30]
    for _ in range(80):
        t = ""
        for _ in range(rng.randint(1, 4)):
            b = rng.choice(base)
            i = rng.randrange(len(b))
            t += b[i:i + rng.randint(10, 120)] + "".join(rng.choice("abcdé") for _ in range(rng.randint(0, 20)))
        out.append(t)
    return out


@pytest.mark.parametrize(("least", "seed", "group"), [(40, 12, 1000), (40, 12, 12)])
def test_removal_matches_brute_force(spark, least, seed, group):
    texts = pasted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = sd.remove_repeats(docs, least=least, seed=seed, group=group).collect()
    want = dict(enumerate(without_repeats(texts, least)))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows} == want


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = Counter((i, *x) for (i, _), x in zip(rows, without_repeats([t for _, t in rows], 60), strict=True))
    got = sd.remove_repeats(odd, least=60, seed=20).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want
    assert sd.remove_repeats(none).count() == 0


def test_named_repeats_have_all_their_occurrences(spark):
    least, texts = 40, [t for t in pasted(8)[5:45]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, owners, repeats = sd.find_repeats(docs, least=least, seed=12)
    owner = {r.h1: r.doc for r in owners.collect()}
    groups = {}
    for r in repeats.collect():
        body = texts[owner[r.ref]].encode()[r.start:r.end]
        assert len(body) >= least
        groups.setdefault(body, set()).add((owner[r.ref], r.start))
    distinct = [texts[i].encode() for i in sorted(owner.values())]
    assert groups and all(len(g) >= 2 for g in groups.values())
    # every doubled window of the corpus lies in a group
    seen = {}
    for t in distinct:
        for i in range(len(t) - least + 1):
            seen[t[i:i + least]] = seen.get(t[i:i + least], 0) + 1
    assert all(any(w in body for body in groups) for w, n in seen.items() if n > 1)


def test_anchors_do_not_depend_on_blocks(monkeypatch):
    import numpy as np
    data = np.random.default_rng(2).integers(97, 100, 5000).astype(np.uint8)
    whole = sd.anchors(data, 60, 20)
    monkeypatch.setattr(sd, "SCAN", 300)
    parts = sd.anchors(data, 60, 20)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


def test_interval_tree_names_all_repeats():
    text = "banana"
    suffixes = sorted(range(6), key=lambda i: text[i:])
    lcp = [0] + [sd.common_prefix(text[a:].encode(), text[b:].encode()) for a, b in zip(suffixes, suffixes[1:], strict=False)]
    found = {(text[suffixes[a]:][:d], b - a + 1) for a, b, d in sd.lcp_intervals(lcp)}
    assert {("a", 3), ("ana", 2), ("na", 2)} <= found


def test_removal_takes_its_spans_from_the_maximal_repeats(monkeypatch):
    import pandas as pd
    rng, found, split = random.Random(3), [], sd.maximal_repeats
    monkeypatch.setattr(sd, "maximal_repeats", lambda *a: (found.append(x) or x for x in split(*a)))
    word = lambda: "".join(rng.choice("ab") for _ in range(8)).encode()
    sides = sorted({(word(), b"s" + word()) for _ in range(60)})  # all share a seed
    group = pd.DataFrame([(0, i, 100, hash(x), hash(y), x, y) for i, (x, y) in enumerate(sides)], columns=sd._CONTEXT)
    got = {r.ref: (100 - r.start, r.end - 100) for r in sd._spans(group, 8, False).itertuples()}
    want = {}
    for i, (x, y) in enumerate(sides):
        for j, (u, v) in enumerate(sides):
            k, r = sd.common_prefix(x, u), sd.common_prefix(y, v)
            if i != j and k + r >= 8:
                want[i] = tuple(map(max, want.get(i, (0, 0)), (k, r)))
    assert found and got == want


def test_widest_repeat_of_each_member_is_found_without_the_whole_tree():
    rng = random.Random(11)
    for _ in range(30):
        side = lambda: bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 9)))
        pairs = sorted({(side(), side()) for _ in range(rng.randint(2, 60))})
        lefts, rights = [a for a, _ in pairs], [b for _, b in pairs]
        want = [{}, {}]
        for members, k, r in sd.maximal_repeats(sd.suffix_nodes(lefts, rights, 6), 6):
            for i in members.tolist():
                want[0][i], want[1][i] = max(want[0].get(i, 0), k), max(want[1].get(i, 0), r)
        before, after = sd.hull(sd.suffix_nodes(lefts, rights, 6), len(pairs), 6)
        assert before.tolist() == [want[0].get(i, 0) for i in range(len(pairs))]
        assert after.tolist() == [want[1].get(i, 0) for i in range(len(pairs))]


def test_production_parameters_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {i: x for (i, _), x in zip(rows, without_repeats([t for _, t in rows], 400), strict=True)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.remove_repeats(docs).collect()}
    assert got == want and any(x[1] for x in want.values())
