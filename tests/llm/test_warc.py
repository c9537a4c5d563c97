import gzip
import os
import hashlib
import base64

from docloom.llm import warc


def test_arc_versions_and_truncation():
    rows = [(1, "http://a/b c", b"<p>\n"), (None, None, b""), (3, "http://x\ny", b"WARC/1.0\r\n\r\n")]
    for version in (1, 2):
        data = warc.arc_container("n 1.arc", version, rows)
        got = list(warc.parse_arc(data))
        assert [(r["page_id"], r["payload"], r["truncated"]) for r in got] == [(p, b, False) for p, _, b in rows]
        assert got[0]["uri"] == "http://a/b%20c" and got[0]["date"] == "2024-01-01T00:00:00Z" and got[1]["uri"] == "about:blank"
        assert list(warc.parse_arc(data[:-8]))[-1]["truncated"]
    old = b"filedesc://x 0.0.0.0 19990101 text/plain 10\n1 0 Org\nq\nhttp://u v/ 1.2.3.4 199901020304 text/gif 3\nGIF\n"
    r = next(warc.parse_arc(old))
    assert (r["uri"], r["ip"], r["date"], r["mime"], r["payload"], r["head"]) == ("http://u v/", "1.2.3.4", "1999-01-02T03:04:00Z", "text/gif", b"GIF", b"")
    assert list(warc.parse_arc(b"")) == []
    for bad in (b"http://x 1 2 3 4\n", b"filedesc://x 0 1 t 0\n", b"\0\1", b"filedesc://x 0 1 t x\n"):
        assert [r["problem"] is None for r in warc.parse_arc(bad)] == [False]
    assert list(warc._members(gzip.compress(b"ab") + gzip.compress(b"cd") + b"\0\0")) == [b"ab", b"cd"]


def test_bad_records_are_kept_aside(spark):
    good = warc.arc_container("a.arc", 1, [(1, "http://a", b"one"), (2, "http://b", b"two")])
    at = good.index(b"http://b 0.0.0.0")
    broken = good[:at] + b"http://c 0.0.0.0 when text/html 10\n0123456789\n" + good[at:]
    rows = list(warc.parse_arc(broken, "f"))
    assert [(r["page_id"], r["problem"]) for r in rows] == [(1, None), (None, "bad header line"), (2, None)]
    assert rows[1]["payload"] == b"http://c 0.0.0.0 when text/html 10\n0123456789\n"
    arcs = spark.createDataFrame([("x", bytearray(broken)), ("y", bytearray(b"nothing of the kind")), ("z", bytearray(gzip.compress(good))), ("e", bytearray(b""))], "name string, content binary")
    assert sorted(r["page_id"] for r in warc.archive(arcs).collect()) == [1, 1, 2, 2]
    assert {(r["place"], r["problem"]) for r in warc.problems(warc.convert(arcs)).collect()} == {(f"x:{at}", "bad header line"), ("y:0", "no version block")}


def test_the_same_file_twice(spark):
    """Equal names and contents inside: as many rows as records, and every copy a revisit."""
    data = bytearray(warc.arc_container("a.arc", 1, [(1, "http://a", b"one"), (2, "http://b", b"two"), (2, "http://b", b"two")]))
    arcs = spark.createDataFrame([("x", data), ("y", data)], "name string, content binary")
    rows = warc.archive(arcs).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in rows if r["record_type"] == "revisit") == [(1, "revisit", 1)] + 3 * [(2, "revisit", 2)]
    assert len(rows) == 6 and len({r["record_id"] for r in rows}) == 6


def test_broken_gzip_members(spark):
    one, two = (gzip.compress(warc.arc_container(f"{i}.arc", 1, [(i, f"http://{i}", os.urandom(300_000))])) for i in (1, 2))
    bad = bytearray(one + two)
    bad[len(one) + len(two) // 2] ^= 0xFF
    arcs = spark.createDataFrame([("whole", bytearray(one)), ("bad", bad), ("short", bytearray(two[: len(two) // 2])), ("none", None)], "name string, content binary")
    got = warc.convert(arcs)
    assert {(r["place"], r["problem"]) for r in warc.problems(got).collect()} >= {(f"bad:{len(one)}", "broken gzip member"), ("short:0", "broken gzip member")}
    assert [r["page_id"] for r in got.where("NOT truncated AND problem IS NULL").orderBy("record_id").collect()].count(1) == 2
    assert warc._unpack(one + two + b"\0\0")[1] is None and warc._unpack(b"plain") == (b"plain", None)


def test_timestamps():
    assert [warc.timestamp(x) for x in ("1999", "19991", "199913", "1999011", "20000230", "1999010203", "19990101256199", "20240229235959")] == [
        "1999-01-01T00:00:00Z", "1999-01-01T00:00:00Z", "1999-12-01T00:00:00Z", "1999-01-01T00:00:00Z", "2000-02-29T00:00:00Z", "1999-01-02T03:00:00Z", "1999-01-01T23:59:59Z", "2024-02-29T23:59:59Z",
    ]


def test_files_are_cut_by_bytes(spark, tmp_path):
    """Each record is a member of its own, and ordinary gzip readers read whole files."""
    import os

    df = spark.createDataFrame([(i, "u", os.urandom(3000).hex()) for i in range(40)] + [(100, "u", "x" * 3_000_000)], "page_id long, url string, html string").coalesce(1)
    arcs = warc.to_arc(df, each_bytes=30_000)
    assert arcs.count() >= 8
    records = warc.convert(arcs)
    marks = warc.revisits(records)
    path = str(tmp_path / "w")
    warc.write(records.join(marks, "record_id", "left"), path, each_bytes=20_000)
    files = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part")]
    assert len(files) >= 5
    seen = 0
    for f in files:
        data = f.read_bytes()
        members = list(warc._members(data))
        assert gzip.decompress(data) == b"".join(members) and b"WARC-Type: warcinfo" in members[0]
        assert all(m.startswith(b"WARC/1.0") and len(list(warc.parse_warc(m))) == 1 for m in members)
        seen += len(members) - 1
    assert seen == 41 == warc.read(spark, path).count()


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", "x"), (2, "u", "x")], "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS record_id", "3 AS name", "4 AS content")
    assert sorted(r["record_type"] for r in warc.archive(warc.to_arc(df)).collect()) == ["response", "revisit"]


def test_pages(spark):
    same = "<p>same\r\n\r\nWARC/1.0\r\n</p>"
    rows = [(5, "http://a", same), (2, "http://b", same), (9, "http://a", same), (1, "u", "ä€😀"), (7, None, None), (8, "v", ""), (3, "w x", "one")]
    got = {r["page_id"]: r for r in warc.archive(warc.to_arc(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        assert got[i]["payload_bytes"] == len(data)
        assert got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {1: ("response", None), 2: ("response", None), 3: ("response", None), 5: ("revisit", 2), 9: ("revisit", 2), 7: ("response", None), 8: ("revisit", 7)}


def test_repeated_null_and_none(spark):
    df = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (None, "u", "x"), (4, "u", "y")], "page_id long, url string, html string")
    got = warc.archive(warc.to_arc(df)).collect()
    assert sorted(r["record_type"] for r in got) == ["response", "response", "revisit", "revisit"]
    assert warc.archive(warc.to_arc(df.limit(0))).count() == 0


def test_least(spark):
    df = spark.createDataFrame([(1, "u", "x"), (2, "u", "x"), (3, "u", "long one"), (4, "u", "long one")], "page_id long, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in warc.archive(warc.to_arc(df), least=5).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}
