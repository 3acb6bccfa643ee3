import hashlib

import pytest

from cuemill.llm import warc
from cuemill.llm._common import scratch_path


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def expected(rows):
    payloads = {k: (h or "").encode() for k, _, h in rows}
    out = {}
    for k, p in payloads.items():
        first = min(j for j, q in payloads.items() if q == p)
        again = len(p) >= 100 and first != k
        out[k] = (len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first if again else None)
    return out


def result(df):
    return {r["key"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()}


def test_round_trip(spark):
    long = "<p>é</p>" * 40
    rows = [(9, "http://a/ b", long), (3, "http://a/x?y=ü", long), (5, None, "short"), (6, "http://b", "short"), (7, "http://c", None), (8, "http://d", ""), (11, "u", "x" * 99), (12, "u", "x" * 99), (13, "u", "y" * 100), (14, "u", "y" * 100), (15, "u", "\r\n\r\nHTTP/1.1 filedesc:// \n" * 20), (16, "u", "big " * 500_000)]
    assert result(warc.archive_pages(pages(spark, rows))) == expected(rows)


def test_empty_repeated_and_null_keys(spark):
    assert warc.archive_pages(pages(spark, [(1, "u", "x")]).limit(0)).count() == 0
    body = "z" * 200
    got = warc.archive_pages(pages(spark, [(1, "u", body), (1, "u", body), (None, "u", body), (4, "u", body)])).collect()
    assert sorted((str(r["key"]), r["record_type"], r["refers_to"]) for r in got) == [("1", "response", None), ("1", "response", None), ("4", "revisit", 1), ("None", "revisit", 1)]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_files_of_both_versions(spark, tmp_path, version):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    bodies = [b"first body", b"second " * 30, b"second " * 30, b""]
    raw = warc.arc_header(version, "t.arc", "19990102030405")
    for k, b in enumerate(bodies):
        raw += warc.arc_record(version, f"http://h/{k}", "1.2.3.4", "19990102030405", "text/html", http + b, "t.arc", len(raw))
    raw += warc.arc_record(version, "dns:h", "1.2.3.4", "19990102", "text/dns", b"h. 1 IN A 1.2.3.4\n")
    records = list(warc.parse_arc(raw))
    assert [r.payload for r in records[:4]] == bodies and records[4].payload.startswith(b"h. 1 IN")
    (tmp_path / "t.arc").write_bytes(raw)
    rows = warc.convert_archives(spark, str(tmp_path / "t.arc"), scratch_path(spark, "arc")).orderBy("key").collect()
    assert [r["record_type"] for r in rows] == ["response", "response", "revisit", "response", "response"]
    assert rows[2]["refers_to"] == rows[1]["key"] and rows[0]["date"] == "1999-01-02T03:04:05Z"
    assert len({r["record_id"] for r in rows}) == 5


@pytest.mark.parametrize("raw", [b"http://x 1.2.3.4 1999 text/html 10\nshort", b"no header", b"http://x 1.2.3.4 1999 text/html ten\n"])
def test_bad_archives_are_refused(raw):
    with pytest.raises(ValueError):
        list(warc.parse_arc(raw))


def test_dates_and_headers():
    assert warc.warc_date("1999") == "1999-01-01T00:00:00Z" and warc.warc_date("?") == "1970-01-01T00:00:00Z"
    arc = warc.ArcRecord("http://h/", "1.1.1.1", "20000102030405", "text/html", b"HTTP/1.0 200 OK\r\nX: y\r\n\r\nbody", 1)
    (head, block), = warc.parse_warc(warc.gzip_member(warc.warc_record(arc, 5, 2)))
    assert head["WARC-Type"] == "revisit" and head["WARC-Refers-To"] == warc.record_id(2) and block == b"HTTP/1.0 200 OK\r\nX: y\r\n\r\n"


def test_gzip_members_are_read_by_offset():
    parts = [bytes([k % 256]) * (k * 37 % 5000) for k in range(300)]
    raw = b"".join(warc.gzip_member(p) for p in parts)
    for step in (1, 100, 1 << 16):
        assert list(warc.gzip_members(raw, step)) == parts
    with pytest.raises(ValueError):
        list(warc.gzip_members(raw[:-3]))


def test_archives_have_keys_of_their_own_and_bad_ones_are_named(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    for name in ("a.arc.gz", "b.arc", "bad.arc", "cut.arc.gz"):
        raw = warc.arc_header(1, name, "19990102030405") + warc.arc_record(1, f"http://h/{name}", "1.2.3.4", "1999", "text/html", http + name.encode() * 9)
        raw += b"broken line\n" if name == "bad.arc" else b""
        raw = warc.gzip_member(raw) if name.endswith("gz") else raw
        (tmp_path / name).write_bytes(raw[:-4] if name.startswith("cut") else raw)
    folder = scratch_path(spark, "arc")
    rows = warc.convert_archives(spark, str(tmp_path / "*.arc*"), folder).orderBy("key").collect()
    assert [(r["key"], r["url"]) for r in rows] == [(0, "http://h/a.arc.gz"), (1 << 32, "http://h/b.arc")]
    refused = spark.read.parquet(f"{folder}/_refused").collect()
    assert sorted(r["path"].rpartition("/")[2] for r in refused) == ["bad.arc", "cut.arc.gz"]


def test_clashing_columns(spark):
    table = pages(spark, [(1, "u", "x" * 200), (2, "u", "x" * 200)]).selectExpr("*", "7 AS digest", "'s' AS size", "1 AS refers_to", "'k' AS key")
    assert result(warc.archive_pages(table)) == expected([(1, "u", "x" * 200), (2, "u", "x" * 200)])
