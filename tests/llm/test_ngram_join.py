import random
from collections import Counter

import numpy as np
from llm_brute import near_groups
from tickforge.llm import ngram_join as nj
from tickforge.llm.components import components


def variants(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows, passage = [], [rng.choice(vocab) for _ in range(40)]
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 160))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 6, 10])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append(copy)
    rows += [passage + [rng.choice(vocab) for _ in range(rng.randint(0, 25))] for _ in range(40)]
    texts = [" ".join(r) for r in rows]
    texts[3] = texts[3].upper() + "\n"
    return list(enumerate(texts))


def test_components_match_brute_force(spark, monkeypatch):
    rows = variants()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = Counter(near_groups(rows))
    # Small blocks, leaves and salts make the split paths run; few frequent shingles too.
    for name, value in (("BLOCK_ROWS", 5), ("LEAVES_PER_SALT", 2), ("FREQUENT", 8), ("LEAF", 2)):
        monkeypatch.setattr(nj, name, value)
    assert Counter(tuple(r) for r in nj.component_ids(docs).collect()) == want


def test_odd_rows(spark, odd, none):
    got = Counter(tuple(r) for r in nj.component_ids(odd).collect())
    assert got == Counter(near_groups([(r.doc_id, r.text) for r in odd.collect()]))
    assert nj.component_ids(none).count() == 0
    first = nj.first_of_group(odd)
    assert first.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in first.collect()) == sorted(
        (i is None, i or 0) for i, _, c in got.elements() if i == c)


def test_tree_finds_every_pair_that_counts_permit():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 6, size=(150, nj.GROUPS)).astype(np.uint16)
    points[100:] = points[:50]
    points[100:, :4] += 1
    size = points.sum(axis=1).astype(np.int64)
    found = {(int(a), int(b)) for x, y in nj.RTree(size, points).join(nj.RTree(size, points), 80)
             for a, b in zip(x, y, strict=True)}
    for a in range(150):
        for b in range(150):
            both = int(np.minimum(points[a], points[b]).sum())
            small, large = sorted((size[a], size[b]))
            assert ((a, b) in found) == (180 * both >= 80 * (size[a] + size[b]) and 100 * small >= 80 * large)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 201: 200}
    assert components(edges.limit(0)).count() == 0


def test_vectors_of_huge_sets_are_exact():
    import numpy as np
    from tickforge.llm import ngram_join as nj
    s = np.arange(200_000, dtype=np.uint64)  # all in one group
    v = nj.read_vector(nj.count_vector(s).tobytes())
    assert v[0] == 200_000 and v.sum() == 200_000
    assert nj.read_vector(nj.count_vector(s[:1000]).tobytes()).dtype == np.uint16
    points = np.stack([v.astype(np.uint32)] * 2)
    tree = nj.RTree(np.array([200_000] * 2), points)
    assert {(int(a), int(b)) for x, y in tree.join(tree, 80) for a, b in zip(x, y)} == {(0, 0), (0, 1), (1, 0), (1, 1)}
