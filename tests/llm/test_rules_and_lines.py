import re
from collections import Counter

from llm_brute import lines_after
from tickforge.llm import line_dedup, quality_rules

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    ws = WORD.findall(text or "")
    win = Counter(tuple(ws[i:i + 5]) for i in range(len(ws) - 4))
    inside = {k for i in range(len(ws) - 4) if win[tuple(ws[i:i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines),
            len(lines) - len(set(lines)), len(inside))


def test_measures_match_brute_force(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = Counter(tuple(r) for r in quality_rules.ledger(docs).drop("fail_bits").collect())
    want = Counter((r.doc_id, *[measured(r.text)[i] for i in (1, 2, 0, 3, 4, 5)]) for r in docs.collect())
    names = quality_rules.ledger(docs).columns
    order = [names.index(c) for c in ("doc_id", "word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines", "n_repeat_words")]
    assert Counter(tuple(r[i] for i in order) for r in got.elements()) == want


def test_policies_and_ablation(spark, odd, none):
    rows = quality_rules.ledger(spark.read.parquet(f"{SF}/documents.parquet")).cache()
    bits = [r.fail_bits for r in rows.collect()]
    for version, mask in quality_rules.POLICIES.items():
        kept = quality_rules.apply_policy(rows, version).where("kept").count()
        assert kept == sum(b & (mask | quality_rules.BASE) == 0 for b in bits)
    for r in quality_rules.ablation(rows).collect():
        bit = 1 << next(x.bit for x in quality_rules.RULES if x.name == r.rule)
        assert r.n_failed == sum(b & bit != 0 for b in bits) and r.n_only == sum(b == bit for b in bits)
    assert quality_rules.ledger(none).count() == 0
    assert all(r.n_failed == 0 for r in quality_rules.ablation(quality_rules.ledger(none)).collect())
    kept = quality_rules.keep(odd)
    assert kept.columns == odd.columns and all(r.body == "x" for r in kept.collect())


def test_lines_match_brute_force(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = docs.collect()
    want = Counter(lines_after([(r.doc_id, r.text) for r in rows]))
    for batches, fanout in ((1, 2), (5, 2)):
        got = Counter((r.doc_id, r._n_lines, r._n_dropped, r._kept_text)
                      for r in line_dedup.dedup_text(docs, batches=batches, fanout=fanout).collect())
        assert got == want, (batches, fanout)


def test_lines_of_odd_tables(odd, none):
    done = line_dedup.dedup_text(odd).collect()
    assert len(done) == odd.count() and all(r.body == "x" and r.n == 1 for r in done)
    assert {r._n_lines for r in done if r.doc_id == 1} == {1}
    assert line_dedup.dedup_text(none).count() == 0


def test_runs_are_compacted(spark):
    index = line_dedup.LineIndex(spark, fanout=2, buckets=2)
    try:
        for i in range(4):
            index.add(spark.createDataFrame([(i, i, i)], "h1 long, h2 long, first long"))
        assert [len(x) for x in index.levels] == [0, 0, 1]
        keys = spark.createDataFrame([(1, 1), (9, 9)], "h1 long, h2 long")
        assert {r.h1: r.first for r in index.lookup(keys).collect()} == {1: 1, 9: None}
    finally:
        index.drop()
