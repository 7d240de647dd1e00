import zlib

import numpy as np
from tickforge.llm import quality_knn as qk

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = qk.score(docs, qk.fit(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    marks = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.score, marks[r.doc_id]) for r in rows if r.held_out and r.doc_id in marks]
    good, bad = ([s for s, m in held if m == x] for x in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95 and all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_blocked_vote_equals_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = qk.fit(docs, labels, sample=100, dims=16)
    assert len(model.votes) <= 100
    texts = [r.text for r in docs.limit(40).collect()]
    got = model.score(texts, 7, block=9)
    for t, s in zip(texts, got, strict=True):
        cosine = (model.embed(qk.term_counts([t])) @ model.vectors.T)[0]
        near = np.sort(cosine)[::-1][:7]
        chosen = np.flatnonzero(cosine >= near[-1])[:7]
        weight = np.maximum(cosine[chosen], 0) ** qk.SHARPNESS + 1e-9
        assert abs(s - (weight * model.votes[chosen]).sum() / weight.sum()) < 1e-5


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 0), (6, None), (7, 0), (8, 1), (8, 1)], "doc_id long, quality int")
    model = qk.fit(odd, labels, dims=4)
    rows = qk.score(odd, model).collect()
    assert len(rows) == odd.count()
    assert all(r.score == model.prior for r in rows if r.doc_id in (1, 2))
    assert qk.score(none, model).count() == 0
    empty = qk.fit(odd, labels.limit(0))
    assert {r.score for r in qk.score(odd, empty).collect()} == {0.5}


def test_nearest_takes_the_first_of_equals():
    import numpy as np
    from tickforge.llm.quality_knn import nearest
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, (50, 40)).astype(np.float32)
    for row, got in zip(x, nearest(x, 9), strict=True):
        assert set(got.tolist()) == set(np.lexsort((np.arange(40), -row))[:9].tolist())
