import base64
import hashlib

import pytest
from tickforge.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, block string, first long"
LONG = "".join(f"<p>päragraph {i}\r\n\r\nWARC/1.1\r\n</p>" for i in range(900))
ROWS = [(3, "http://a/1", "same"), (1, "http://a/2", "same"), (2, "http://a/3", "same"), (4, None, None),
        (5, "http://a/\r\nX: y", ""), (6, "u", LONG), (7, "u", LONG), (None, "u", "only null"), (None, "u", "same"),
        (8, "u", "twice"), (8, "u", "twice"), (9, "u", "\r\n\r\n0\r\n\r\n")]


def expected(rows):
    out, first = [], {}
    for i, _, h in rows:
        order = (i is None, i or 0)
        first[h or ""] = min(first.get(h or "", order), order)
    for i, _, h in rows:
        data, order = (h or "").encode(), (i is None, i or 0)
        again = order > first[h or ""]
        out.append((str(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "revisit" if again else "response", str(first[h or ""][1]) if again else "None"))
    return sorted(out)


@pytest.mark.parametrize(("segment", "chunk", "per_file"), [(300, 100, 7), (65_536, 4096, 1000)])
def test_round_trip(spark, tmp_path, segment, chunk, per_file):
    pages = spark.createDataFrame([(*r, "p", "b", 1) for r in ROWS], SCHEMA).repartition(3)
    folder = str(tmp_path / "archives")
    warc.write_archives(pages, folder, segment=segment, chunk=chunk, records_per_file=per_file)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to))
                 for r in warc.read_archives(spark, folder).collect())
    assert got == expected(ROWS)


def test_empty_table(spark, tmp_path):
    folder = str(tmp_path / "none")
    warc.write_archives(spark.createDataFrame([], SCHEMA), folder)
    assert warc.read_archives(spark, folder).count() == 0


def test_missing_segment_raises(spark, tmp_path):
    folder = tmp_path / "broken"
    warc.write_archives(spark.createDataFrame([(6, "u", LONG, "", "", 1)], SCHEMA), str(folder), segment=5000, records_per_file=1)
    next(f for f in sorted(folder.glob("part-*"))[1:]).unlink()
    with pytest.raises(Exception, match="segments"):
        warc.read_archives(spark, str(folder)).collect()


def rewritten(folder, change):
    """Archives of the folder with their bytes changed."""
    import gzip
    out = folder.parent / "changed"
    out.mkdir()
    for f in folder.glob("part-*"):
        (out / f.name).write_bytes(gzip.compress(change(gzip.decompress(f.read_bytes()))))
    return str(out)


@pytest.mark.parametrize("segment", [65_536, 60])
def test_damaged_payload_raises(spark, tmp_path, segment):
    folder = tmp_path / "good"
    warc.write_archives(spark.createDataFrame([(1, "u", "some body text " * 9, "", "", 1)], SCHEMA), str(folder), segment=segment)
    bad = rewritten(folder, lambda data: data.replace(b"body", b"bodi", 1))
    with pytest.raises(Exception, match="declared"):
        warc.read_archives(spark, bad).collect()


def test_revisit_without_its_response_raises(spark, tmp_path):
    folder = tmp_path / "good"
    pages = spark.createDataFrame([(1, "u", "same", "", "", 1), (2, "u", "same", "", "", 1), (3, "u", "other", "", "", 1)], SCHEMA)
    warc.write_archives(pages.coalesce(1), str(folder), records_per_file=1)

    def without_first(data):
        fields, _ = next(warc.records(data))
        return b"" if fields["warc-type"] == "response" and ":1:" in fields["warc-record-id"] else data

    with pytest.raises(Exception, match="no response for the revisit of page 2"):
        warc.read_archives(spark, rewritten(folder, without_first)).collect()


def test_chunk_framing():
    assert warc.dechunk(b"3\r\nabc\r\nA;x=y\r\n0123456789\r\n0\r\n\r\n") == b"abc0123456789"
    with pytest.raises(ValueError):
        warc.dechunk(b"3\r\nabcd\r\n0\r\n\r\n")
