import re

import corpus_pipeline
import duckdb
from llm_brute import lines_after, near_groups
from pyspark.sql import functions as F
from test_packing import check
from test_rules_and_lines import measured
from tickforge.llm import packing

SF = "/root/testdata/sf0.001"


def kept_by_rules(text):
    words, chars, symbols, lines, again, repeated = measured(text)
    return not (words < 10 or 100 * repeated > 20 * words or 10 * symbols > words or chars < 3 * words
                or chars > 10 * words or 10 * again > 3 * lines)


def brute():
    """What every stage leaves, as {doc_id: text}; single process."""
    con = duckdb.connect()
    rows = con.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    items = [t for _, t in con.execute(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()]
    plain = lambda s: re.sub(r"[\W_]+", " ", s.lower()).strip()
    stages = [dict(rows)]
    stages.append({i: t for i, t in rows if kept_by_rules(t)})
    stages.append({i: t for i, n, gone, t in lines_after(list(stages[-1].items())) if gone < n})
    groups = near_groups(list(stages[-1].items()))
    stages.append({i: stages[-1][i] for i, _, c in groups if i == c})
    stages.append({i: t for i, t in stages[-1].items() if not any(plain(x) in plain(t) for x in items)})
    return stages[1:]


def test_every_stage_matches_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], brute(), strict=True):
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        path = str(tmp_path / name.replace(" ", "_"))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        rows = docs.collect()
        assert {r.doc_id: r.text for r in rows} == want, name
        assert all(r.n_chars == len(r.text) for r in rows), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    totals = {r.doc_id: r.n for r in docs.select("doc_id", packing.word_count(F.col("text")).alias("n")).collect()}
    check(packed.collect(), totals, packing.CAPACITIES)


def test_odd_rows_pass_every_stage(spark, odd, none, tmp_path):
    for docs in (odd.withColumn("n_chars", F.length("text").cast("long")), none.withColumn("n_chars", F.lit(0).cast("long"))):
        for number, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            before, out = sorted(str((r.doc_id, r.text)) for r in docs.collect()), stage(spark, docs, SF)
            assert out.columns == docs.columns
            after = sorted(str((r.doc_id, r.text)) for r in out.collect())
            if name == "quality rules":
                assert after == sorted(str((r.doc_id, r.text)) for r in docs.collect() if kept_by_rules(r.text or ""))
            elif name == "line dedup":
                kept = [(i, t) for i, n, gone, t in lines_after([(r.doc_id, r.text) for r in docs.collect()]) if gone < n]
                assert after == sorted(str(x) for x in kept)
            elif name == "n-gram Jaccard join":  # rows that share an id are one document
                rows = [(r.doc_id, r.text) for r in docs.collect()]
                assert after == sorted(str(x) for x, (i, _, c) in zip(rows, near_groups(rows), strict=True) if i == c)
            else:
                assert after == before  # no passage of the benchmark
            path = str(tmp_path / f"{number}{docs is none}{id(docs)}")
            out.write.parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= 0
