import itertools
import random
import zlib
from collections import Counter

import pytest

from tickforge.llm import spelling as S
from tickforge.llm.fm_index import Vocabulary, rotation_order


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(rows, least_length=5, least_count=3):
    counts = Counter()
    for i, t in rows:
        low = "".join(c.lower() if c < "\x80" else c for c in t or "")
        for run in S.RUN.findall(low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1:] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least_length and c >= least_count}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and edits(v, w) == 1] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 2 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, n[w], len(near[w]), form.get(w), n[form[w]] if w in form else None, root))
    return sorted(out)


def texts(seed=1, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 9))) for _ in range(150)]
    words += ["a" * 30, "a" * 31, "b" + "a" * 30, "×÷aab", "ÉAABB".lower(), "ÀAÀAB", "Zulu" * 5]
    out = [(i, rng.choice([" ", "-", "\n", "1"]).join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(n)]
    out.append((n + 2, "kettle " * 3 + "kettles " * 7 + "kettless " * 15 + "ketttless " * 40))
    return [*out, (None, None), (n, ""), (n, out[0][1]), (n, out[0][1].upper()), (n + 1, "x" * 40_000 + " " + "x" * 40_000)]


def test_rotations_are_sorted():
    import numpy as np
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 50, 400):
        x = np.append(0, rng.integers(1, 3, n)).astype(np.uint8)
        doubled = bytes(x) * 2
        want = sorted(range(n + 1), key=lambda i: doubled[i:i + n + 1])
        assert rotation_order(x).tolist() == want


def test_intervals_of_both_orders_agree():
    words = sorted({bytes(w) for r in range(1, 5) for w in itertools.product(b"abc", repeat=r)})
    index = Vocabulary(words)
    text = b"\0" + b"\0".join(words)
    circle = text + text[:8]
    parts = [b"a", b"\0ab", b"cc\0", b"abca", b"zz", b"\0abc\0"]
    fore, back, size = index.exact(parts)
    for p, f, n in zip(parts, fore, size, strict=True):
        places = sorted(i for i in range(len(text)) if circle[i:i + len(p)] == p)
        assert n == len(places) and sorted(index.order[f:f + n].tolist()) == places
    mirror = rotation_order(__import__("numpy").frombuffer(text, "uint8")[::-1])
    for p, b, n in zip(parts, back, size, strict=True):
        ends = sorted((len(text) - 1 - (i + len(p) - 1)) % len(text) for i in range(len(text)) if circle[i:i + len(p)] == p)
        assert sorted(mirror[b:b + n].tolist()) == ends


@pytest.mark.parametrize("seed", range(6))
def test_search_finds_exactly_the_words_one_error_away(seed):
    rng = random.Random(seed)
    words = sorted({bytes(rng.choice(b"ab\xe9") for _ in range(rng.randint(4, 10))) for _ in range(400)})
    index = Vocabulary(words)
    patterns = sorted({*words[:200], *(bytes(rng.choice(b"abz") for _ in range(rng.randint(4, 9))) for _ in range(50))})
    got = {}
    for side in (0, 1):
        for p, n, *_ in S._search(index, words, [1] * len(words), side, patterns):
            got[p] = got.get(p, 0) + n
    want = {p.decode("latin-1"): sum(edits(p, w) == 1 for w in words) for p in patterns}
    assert got == {p: n for p, n in want.items() if n}


@pytest.mark.parametrize("block", [40_000, 7])
def test_variants_match_brute_force(spark, block):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = S.variants(docs, block=block).select("word", "n", "n_near", "form", "form_n", "root").collect()
    want = brute(rows)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert any(w[3] for w in want) and any(w[5] not in (w[0], w[3]) for w in want)


def test_counts_flush_and_add_up(spark):
    rows = texts(2, 30)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert {r.word: r.n for r in S.word_counts(docs, flush=10).where("n >= 3").collect()} == {w[0]: w[1] for w in brute(rows)}


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = S.variants(odd).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)
    assert S.variants(none).count() == 0
