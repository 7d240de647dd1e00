"""CSV files by header, and streams that survive a restart."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tickforge.sources import bars as B
from tickforge.streaming import ingest as ST

SCHEMA = "symbol string, date timestamp_ntz, open double, high double, low double, close double, volume double, ingest_seq long"


def test_columns_follow_each_files_header(spark, tmp_path):
    for name, text in (("stock_metadata.csv", "Company,Industry\nx,y\n"), ("AAA.csv", "Date,Open,High,Low,Close,Volume\n2024-01-01,1,3,0.5,2,10\n"),
                       ("BBB.csv", "Volume,Date, CLOSE ,Opening,High,Low\nNaN,2024-01-01,2,1,3,0.5\n"),
                       ("CCC.csv", "Date,Open,High,Low,Close,Volume\n"), ("DDD.csv", "")):
        (tmp_path / name).write_text(text)
    rows = {r.symbol: r for r in B.scan_bars_csv(spark, str(tmp_path)).collect()}
    assert set(rows) == {"AAA", "BBB"}
    assert (rows["BBB"].open, rows["BBB"].close, rows["BBB"].volume) == (1.0, 2.0, None)
    assert (rows["AAA"].open, rows["AAA"].close, rows["AAA"].volume) == (1.0, 2.0, 10.0)
    good, bad = B.scan_csv_validated(spark, str(tmp_path))
    assert good.count() == 2 and bad.count() == 0
    assert [r.symbol for r in B.scan_bars_csv(spark, str(tmp_path), ["BBB"]).collect()] == ["BBB"]
    (tmp_path / "EEE.csv").write_text("Date,Open\n2024-01-01,1\n")
    with pytest.raises(ValueError, match="lack the columns"):
        B.scan_csv_validated(spark, str(tmp_path))


def test_many_files_and_headers_without_a_driver_read(spark, tmp_path, monkeypatch):
    heads = ["Date,Open,High,Low,Close,Volume", "close,date,open,high,low,volume", "\ufeffdate,open,high,low,close,volume,extra"]
    for i in range(300):
        folder = tmp_path / f"part{i % 7}"
        folder.mkdir(exist_ok=True)
        kind = 0 if i % 10 else 1 + i % 20 // 10
        day = "2024-01-01"
        line = [f"{day},1,3,0.5,{i},10", f"{i},{day},1,3,0.5,10", f"{day},1,3,0.5,{i},10,x{i}"][kind]
        (folder / f"S{i}.csv").write_text("\n" * (i % 3 == 0) + f"{heads[kind]}\n{line}\n", encoding="utf-8")
    (tmp_path / "stock_metadata.csv").write_text("Company,Industry\nx,y\n")
    opened = []
    monkeypatch.setattr(type(spark._jvm.org.apache.hadoop.fs), "__getattr__", opened.append, raising=False)
    headers = B.csv_headers(spark, str(tmp_path))
    monkeypatch.undo()
    assert not opened and headers.count() == 300 and len(B.distinct_headers(headers)) == 3
    rows = {r.symbol: r for r in B.scan_bars_csv(spark, str(tmp_path), headers=headers).collect()}
    assert len(rows) == 300 and all(rows[f"S{i}"].close == i and rows[f"S{i}"].high == 3.0 for i in range(300))
    assert {s for s, r in rows.items() if r.extra} == {f"S{i}" for i in range(300) if i % 20 == 10}
    # a symbol's file is chosen before any data is read
    one = B.scan_bars_csv(spark, str(tmp_path), ["S7"], headers)
    assert [r.symbol for r in one.collect()] == ["S7"]


def test_failover_reads_later_sources_for_missing_symbols_only(spark):
    rows = lambda *s: spark.createDataFrame([(x, d, float(d)) for x in s for d in (1, 2)], "symbol string, date int, close double")
    got = B.source_failover([("a", rows("X", None)), ("b", rows("X", "Y", None)), ("c", rows("Y", "Z").withColumn("more", F.lit(1)))])
    assert sorted((r.symbol or "", r.date, r.source) for r in got.collect()) == [
        ("", 1, "a"), ("", 2, "a"), ("X", 1, "a"), ("X", 2, "a"), ("Y", 1, "b"), ("Y", 2, "b"), ("Z", 1, "c"), ("Z", 2, "c")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LeftAnti") == 2
    assert B.source_failover([("a", rows("X"))]).count() == 2


def bar(symbol, day, close, n):
    return (symbol, dt.datetime(2024, 1, day), 1.0, 100.0, 0.5, close, 1.0, n)


def land(spark, folder, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(os.path.join(folder, name))


def closes(df):
    return {(r.symbol, r.date.day): r.close for r in df.collect()}


def test_ingest_restarts_without_loss(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, src, [bar("A", d, 2.0, d) for d in range(1, 6)], "b1")
    args = (src + "/*", out, spark.createDataFrame([], SCHEMA).schema)
    assert len(closes(ST.stream_ingest(spark, *args))) == 5
    # a new session: a late row, a duplicate, a correction and another symbol
    again = spark.newSession()
    land(spark, src, [bar("A", 1, 2.0, 1), bar("A", 2, 9.0, 50), bar("B", 1, 3.0, 1),
                      ("A", dt.datetime(1990, 1, 1), 1.0, 100.0, 0.5, 4.0, 1.0, 1)], "b2")
    got = ST.stream_ingest(again, *args)
    rows = got.collect()
    assert len(rows) == 7 and {r.close for r in rows if r.date.year == 1990} == {4.0}
    assert closes(got)["A", 2] == 9.0 and closes(got)["B", 1] == 3.0
    # another checkpoint reads all again and overwrites nothing
    assert ST.stream_ingest(again, *args, checkpoint_location=str(tmp_path / "other")).count() == 7
    ST.compact_bars(spark, out)
    assert len([f for f in os.listdir(out) if f.startswith("batch=")]) == 1
    assert ST.current_bars(spark, out).count() == 7
    land(spark, src, [bar("C", 1, 5.0, 1)], "b3")
    assert ST.stream_ingest(spark, *args).count() == 8


def test_resample_restarts_and_counts_late_ticks(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "event_type string, ts timestamp, value double, event_id long"
    tick = lambda h, m, v, n: ("x", dt.datetime(2024, 1, 1, h, m), v, n)
    spark.createDataFrame([tick(1, 0, 1.0, 1), tick(1, 30, 5.0, 2)], schema).coalesce(1).write.parquet(src + "/a")
    args = (src + "/*", out, spark.createDataFrame([], schema).schema)
    assert [r.close for r in ST.stream_resample(spark, *args).collect()] == [5.0]
    spark.createDataFrame([tick(3, 0, 7.0, 4), tick(1, 45, 2.0, 3)], schema).coalesce(1).write.parquet(src + "/b")
    got = {r.date.hour: (r.open, r.high, r.close, r.volume) for r in ST.stream_resample(spark.newSession(), *args).collect()}
    assert got == {1: (1.0, 5.0, 2.0, 3.0), 3: (7.0, 7.0, 7.0, 1.0)}


def test_closed_windows_come_once_and_late_ticks_are_set_aside(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "event_type string, ts timestamp, value double, event_id long"
    empty = spark.createDataFrame([], schema)
    tick = lambda day, h, v, n: ("x", dt.datetime(2024, 1, day, h, 10), v, n)
    deliver = lambda rows, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/{name}")
    run = lambda s: ST.stream_resample_closed(s, src + "/*", out, empty.schema)
    deliver([tick(1, 1, 1.0, 1), tick(1, 1, 5.0, 2), tick(1, 2, 3.0, 3)], "a")
    bars, late = run(spark)
    assert bars.count() == 0 and late.count() == 0  # the watermark has passed nothing
    deliver([tick(3, 0, 7.0, 4), tick(1, 2, 4.0, 5)], "b")  # the second is behind, but its window is open
    bars, late = run(spark.newSession())
    got = {r.date.hour: (r.open, r.close, r.volume) for r in bars.collect()}
    assert got == {1: (1.0, 5.0, 2.0), 2: (3.0, 4.0, 2.0)} and late.count() == 0
    deliver([tick(1, 2, 9.0, 6), ("x", None, 1.0, 7), tick(5, 0, 8.0, 8)], "c")  # now too late, and without a time
    bars, late = run(spark)
    assert sorted(r.event_id for r in late.collect()) == [6, 7]
    assert {(r.date.day, r.date.hour): r.volume for r in bars.collect()} == {(1, 1): 2.0, (1, 2): 2.0, (3, 0): 1.0}


def test_redelivered_rows_are_written_once_and_state_stays_small(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    states, start, want = [], 1_700_000_000, {}
    for epoch in range(20):  # one delivery an hour, half of it known from the hour before
        rows = [bar("A", 1 + (10 * epoch + i) % 28, float((10 * epoch + i) % 90 + 11), 10 * epoch + i) for i in range(-10, 10)]
        want |= {(r[0], r[1].day): r[5] for r in rows}
        land(spark, src, rows, f"b{epoch:02d}")
        for file in os.listdir(f"{src}/b{epoch:02d}"):
            os.utime(f"{src}/b{epoch:02d}/{file}", (start + 3600 * epoch,) * 2)
        q = ST.run_ingest(spark, src + "/*", out, spark.createDataFrame([], SCHEMA).schema, redelivery="2 hours")
        states.append(q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress["stateOperators"] else 0)
    assert max(states[4:]) <= max(states[:6]) <= 60
    written = spark.read.parquet(out)
    assert written.count() == 210  # 20 new rows, then 10 an epoch
    assert closes(ST.current_bars(spark, out)) == want


def test_upsert_rewrites_only_what_the_batch_touches(spark, tmp_path):
    from tickforge.operators import merge as MG
    path, schema = str(tmp_path / "bars"), "symbol string, date timestamp_ntz, open double, high double, low double, close double, volume double"
    row = lambda s, m, d, c: (s, m and dt.datetime(2024, m, d), 1.0, 9.0, 0.5, c, 1.0)
    frame = lambda rows: spark.createDataFrame(rows, schema)
    old = [row(s, m, d, 2.0) for s in ("A", "B", None) for m in (1, 2, 3) for d in (1, 2)] + [row("A", None, 1, 3.0)]
    MG.write_bar_table(frame(old), path)
    files = lambda: {os.path.join(f, x): os.stat(os.path.join(f, x)).st_mtime_ns for f, _, xs in os.walk(path) for x in xs if x.endswith(".parquet")}
    before = files()
    batch = [row("A", 2, 2, 5.0), row("A", 2, 3, 6.0), row(None, 3, 1, 7.0), row("C", 1, 1, 8.0), row("A", None, 1, 9.0)]
    MG.upsert_bars(spark, path, frame(batch))
    got = {(r.symbol, r.date): r.close for r in MG.read_bar_table(spark, path, frame([]).schema).collect()}
    want = {(r[0], r[1]): r[5] for r in [*old, *batch]}
    assert got == want
    after = files()
    same = {f for f in before if after.get(f) == before[f]}
    assert len(same) == len(before) - 3 and len(set(after) - set(before)) == 4
    MG.upsert_bars(spark, path, frame([]))
    assert files() == after
