"""ARC to WARC: a converter of legacy web archives, with a writer and a reader for its output.

Files are cut by bytes, on both sides: a file holds about as many records as fill its size, one at least.
"""

from __future__ import annotations

import base64
import calendar
import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, materialise, prepare, release, scratch, shared_dir, spread_join

#: Fixed: field names of the version block, by ARC version.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORD = "record_id string, page_id long, uri string, date string, ip string, mime string, head binary, payload binary, payload_bytes long, digest string, truncated boolean, problem string"
_RECORD = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("date", pa.string()), ("ip", pa.string()), ("mime", pa.string()), ("head", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("truncated", pa.bool_()), ("problem", pa.string())])


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _plain(text: str) -> str:
    """For a header line: without characters that would end it or part its fields."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def arc_container(name: str, version: int, rows: list[tuple[int | None, str | None, bytes]], date: str = "20240101000000") -> bytes:
    """An ARC file of HTTP responses. rows: (page_id, url, payload)."""
    about = f"{version} 0 docloom\n{FIELDS[version]}\n".encode()
    extra = "" if version == 1 else "200 - - 0 " + _plain(name) + " "
    out = [f"filedesc://{_plain(name)} 0.0.0.0 {date} text/plain {extra}{len(about)}\n".encode(), about, b"\n"]
    for page, url, payload in rows:
        named = "" if page is None else f"X-Page-Id: {page}\r\n"
        body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{named}\r\n".encode() + payload
        out += [f"{_plain(url or 'about:blank')} 0.0.0.0 {date} text/html {extra}{len(body)}\n".encode(), body, b"\n"]
    return b"".join(out)


def _header(line: bytes, fields: list[str]) -> dict[str, str] | None:
    """The fields of a header line, or None if it isn't one. Fields are taken from the right, since old URLs may hold blanks."""
    parts = line.decode("utf-8", "replace").rstrip("\r").rsplit(" ", len(fields) - 1)
    head = dict(zip(fields, parts))
    fine = len(parts) == len(fields) and re.fullmatch("[0-9]{1,18}", head["Archive-length"]) and re.fullmatch("[0-9]{4,14}", head["Archive-date"])
    return head if fine else None


def _version_block(data: bytes) -> tuple[str, list[str], int]:
    """Name, fields of a header line and end of the version block; ValueError if the file doesn't begin with one."""
    end = data.find(b"\n")
    first = data[: max(end, 0)].decode("utf-8", "replace").rstrip("\r").split(" ")
    if not first[0].startswith("filedesc://") or not first[-1].isdigit():
        raise ValueError("no version block")
    at = end + 1 + int(first[-1])
    about = data[end + 1 : at].decode("utf-8", "replace").split("\n")
    if len(about) > 1 and {"URL", "Archive-date", "Archive-length", "Content-type", "IP-address"} <= set(about[1].split()):
        return first[0], about[1].split(), at
    version = about[0].split(" ")[0]
    if version not in ("1", "2"):
        raise ValueError("unknown version")
    return first[0], FIELDS[int(version)].split(" "), at


def _aside(problem: str, place: str, held: bytes) -> dict:
    return dict.fromkeys(_RECORD.names) | {"record_id": place, "payload": held, "payload_bytes": len(held), "truncated": False, "problem": problem}


def parse_arc(data: bytes, name: str = "") -> Iterator[dict]:
    """Records of an ARC file as rows of RECORD.

    The version block says which fields a header line has. The declared length parts records; where the file ends early, what is there counts and `truncated` is
    true. What can't be read is kept aside instead of ending the job: a row with `problem`, the bytes up to the next line that is a header as its
    payload (none where the whole file lacks a version block), and nothing else but the place as record_id.
    """

    try:
        about, fields, at = _version_block(data)
    except ValueError as e:
        if data:
            yield _aside(str(e), f"{name}:0", b"")
        return
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        start, head = at, None
        while at < len(data) and head is None:
            end = data.find(b"\n", at)
            end = len(data) if end < 0 else end
            head = _header(data[at:end], fields)
            if head is None:
                at = end + 1
        if at > start:
            yield _aside("bad header line", f"{name}:{start}", data[start:at])
        if head is None:
            break
        length, start = int(head["Archive-length"]), end + 1
        body = data[start : start + length]
        at = start + length
        yield synthesise(head, body, len(body) < length, f"{name or about}:{start}")


def timestamp(digits: str) -> str:
    """A WARC timestamp of 4 to 14 digits: what is left out is the beginning of the year, month or day, and what is out of range the nearest that is valid. Half a number at the end is left out too."""
    digits = digits[: len(digits) // 2 * 2]
    d = digits + "00000101000000"[len(digits) :]
    year, month = max(1, int(d[:4])), min(12, max(1, int(d[4:6])))
    day = min(calendar.monthrange(year, month)[1], max(1, int(d[6:8])))
    return f"{year:04d}-{month:02d}-{day:02d}T{min(23, int(d[8:10])):02d}:{min(59, int(d[10:12])):02d}:{min(59, int(d[12:14])):02d}Z"


def synthesise(head: dict[str, str], body: bytes, truncated: bool, place: str) -> dict:
    """What a WARC record of an ARC record says: identifier (from URL, date, digest and place in the stored file, so copies of a file have records of their own), timestamp, type and digest."""
    http, payload = b"", body
    if body.startswith(b"HTTP/") and (cut := body.find(b"\r\n\r\n")) >= 0:
        http, payload = body[: cut + 4], body[cut + 4 :]
    digest = sha1_base32(payload)
    page = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", http)
    return {
        "record_id": f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{head["URL"]}|{head["Archive-date"]}|{digest}|{place}')}",
        "page_id": int(page[1]) if page else None,
        "uri": head["URL"], "date": timestamp(head["Archive-date"]), "ip": head["IP-address"], "mime": head["Content-type"],
        "head": http, "payload": payload, "payload_bytes": len(payload), "digest": digest, "truncated": truncated, "problem": None,
    }


def to_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", each_bytes: int = 16_000_000) -> DataFrame:
    """Pages as legacy ARC containers of about each_bytes: (name, content binary); versions 1 and 2 in turn. Null html is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, rows, held = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            name = f"part-{part:06d}-{n:06d}.arc"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([arc_container(name, 1 + n % 2, rows)], pa.binary())], names=["name", "content"])

        for batch in batches:
            for page, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                payload = (html.as_py() or "").encode()
                rows.append((page, url, payload))
                held += len(payload)
                if held >= each_bytes:
                    yield out()
                    n, rows, held = n + 1, [], 0
        if rows:
            yield out()
        release()

    prepare(pages.sparkSession)
    return pages.select(F.col(id_col).cast("long"), url_col, html_col).mapInArrow(run, "name string, content binary")


def write_arc(arcs: DataFrame, path: str) -> None:
    """Each container as a file of its own below path; the line end that the writer adds is the one that parts ARC records."""
    arcs.select(F.col("content").cast("string").alias("value")).write.options(lineSep="\n", maxRecordsPerFile=1).text(path)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of the ARC files below path."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("name"), "content")


def convert(arcs: DataFrame, payload: bool = True) -> DataFrame:
    """Records (RECORD) of ARC files. arcs: (name, content binary), such as binaryFile gives; content may be gzipped. payload=False leaves head and payload null, for steps that need neither."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py() or b""
                plain, broken = _unpack(data)
                aside = [] if broken is None else [_aside("broken gzip member", f"{name or ''}:{broken}", data[broken:])]
                rows, held = [], 0
                for r in itertools.chain(parse_arc(plain, name or ""), aside):
                    rows.append(r if payload else r | {"head": None, "payload": None})
                    held += r["payload_bytes"] if payload else 500
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
        release()

    return arcs.select("name", "content").mapInArrow(run, RECORD)


def _members(data: bytes) -> Iterator[bytes]:
    """Each member of a gzip file, unpacked, or the data as it is. Zeros at the end are padding."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    rest = memoryview(data)
    while rest[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        yield z.decompress(rest) + z.flush()
        rest = rest[len(rest) - len(z.unused_data) :]


def _unpack(data: bytes, step: int = 1 << 16) -> tuple[bytes, int | None]:
    """What the members of a gzip file hold, one after another, or the data as it is; and where the first member begins that is broken or ends early, if one does.

    Of that member, what comes out before the fault counts; where the next one begins can't be told, so nothing behind it is read.
    """
    if data[:2] != b"\x1f\x8b":
        return data, None
    out, at = [], 0
    while data[at : at + 2] == b"\x1f\x8b":
        z, end = zlib.decompressobj(31), at
        try:
            while not z.eof and end < len(data):
                out.append(z.decompress(data[end : end + step]))
                end += step
        except zlib.error:
            return b"".join(out), at
        if not z.eof:
            return b"".join([*out, z.flush()]), at
        at = min(end, len(data)) - len(z.unused_data)
    return b"".join(out), None


def problems(records: DataFrame) -> DataFrame:
    """(place, problem, bytes) of what could not be read."""
    return records.where("problem IS NOT NULL").select(F.col("record_id").alias("place"), "problem", F.col("payload").alias("bytes"))


def revisits(records: DataFrame, least: int = 0) -> DataFrame:
    """(record_id, first_id, first_page, first_uri, first_date) of each record whose payload another record has too that has a smaller page_id (ties: record_id): that first one.

    Payloads under `least` bytes have no revisits. The first per digest is a grouped minimum, combined before the shuffle; only digests that occur twice or more go into the
    join, where the rows of a digest that very many records share are dealt by their own ids. Payloads are not needed here.
    """
    seen = records.where((F.col("payload_bytes") >= least) & F.col("problem").isNull()).select("digest", "record_id", "page_id", "uri", "date")
    first = seen.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("page_id", "record_id", "uri", "date")).alias("f")).where("n > 1").select("digest", "f")
    others = spread_join(seen, first, "digest", "record_id").where("record_id <> f.record_id")
    return others.select("record_id", F.col("f.record_id").alias("first_id"), F.col("f.page_id").alias("first_page"), F.col("f.uri").alias("first_uri"), F.col("f.date").alias("first_date"))


def warc_record(r: dict) -> bytes:
    """A WARC/1.0 record. r: a row of RECORD with first_*."""
    revisit = r["first_id"] is not None
    http = bool(r["head"])
    block = r["head"] if revisit else (r["head"] or b"") + (r["payload"] or b"")
    h = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response' if http else 'resource'}", f"WARC-Record-ID: <{r['record_id']}>", f"WARC-Date: {r['date']}", f"WARC-Target-URI: {r['uri']}", f"WARC-IP-Address: {r['ip']}"]
    h += [f"WARC-Payload-Digest: sha1:{r['digest']}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}"]
    if revisit:
        h += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <{r['first_id']}>", f"WARC-Refers-To-Target-URI: {r['first_uri']}", f"WARC-Refers-To-Date: {r['first_date']}"]
        if r["first_page"] is not None:
            h.append(f"X-Refers-To-Page: {r['first_page']}")
    if r["truncated"]:
        h.append("WARC-Truncated: unspecified")
    h += [f"Content-Type: {'application/http; msgtype=response' if http else r['mime']}", f"Content-Length: {len(block)}"]
    return "\r\n".join(h).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warcinfo(name: str, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """The record that opens a file."""
    block = b"software: docloom\r\nformat: WARC File Format 1.0\r\n"
    h = ["WARC/1.0", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(h).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def write(records: DataFrame, path: str, each_bytes: int = 16_000_000) -> None:
    """WARC files below path, by Spark's own writer. records: rows of RECORD with first_*; those with a problem are left out.

    A file begins with a warcinfo record and holds about each_bytes, compressed, one record at least; each record is a gzip member of its own, so it can be read from its place alone.
    The writer ends a file with a zero byte, which gzip readers take for padding.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, members, held = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            info = _member(warcinfo(f"part-{part:06d}-{n:06d}.warc.gz"))
            return pa.RecordBatch.from_arrays([pa.array([b"".join([info, *members])], pa.binary())], names=["value"])

        for batch in batches:
            for r in (r for at in range(0, batch.num_rows, 50) for r in batch.slice(at, 50).to_pylist()):
                members.append(_member(warc_record(r)))
                held += len(members[-1])
                if held >= each_bytes:
                    yield out()
                    n, members, held = n + 1, [], 0
        if members:
            yield out()
        release()

    made = records.where("problem IS NULL").mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    made.write.options(lineSep="\0", maxRecordsPerFile=1).text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record, parted by declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError(f"no end of headers after byte {at}")
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        n = int(head["content-length"])
        yield head, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def _page_row(head: dict[str, str], block: bytes) -> dict:
    cut = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
    http, payload, digest = block[:cut], block[cut:], head["warc-payload-digest"].removeprefix("sha1:")
    said = re.search(rb"\r\nContent-Length: (\d+)\r\n", http)
    page = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", http)
    revisit = head["warc-type"] == "revisit"
    if not revisit and sha1_base32(payload) != digest:
        raise ValueError(f"{head['warc-record-id']}: the payload has another digest")
    to = head.get("x-refers-to-page")
    return {
        "record_id": head["warc-record-id"].strip("<>"), "page_id": int(page[1]) if page else None, "uri": head["warc-target-uri"], "record_type": head["warc-type"],
        "payload_bytes": int(said[1]) if revisit and said else len(payload), "payload_digest": digest, "refers_to": int(to) if to else None,
    }


def read(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, page_id, uri, record_type, payload_bytes, payload_digest, refers_to) of every record below path but warcinfo.

    A response's bytes and digest are computed from its payload, and a digest that differs from the header's raises ValueError; a revisit's come from its headers.
    """
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for member in _members(content.as_py()):
                    rows += [_page_row(head, block) for head, block in parse_warc(member) if head["warc-type"] != "warcinfo"]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
        release()

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "record_id string, page_id long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long")


def archive(arcs: DataFrame, least: int = 0, each_bytes: int = 16_000_000) -> DataFrame:
    """Store ARC files in the shared folder, convert them to WARC files there, repeated payloads as revisits, and read those back. No files, no rows. What can't be read is left out; see problems().

    A file that is there twice has its records twice, the later ones as revisits; pages repeated or without an id (null) are records of their own, null urls about:blank, null contents files without records.
    """
    spark = arcs.sparkSession
    shared_dir(spark)
    legacy, path = scratch(spark, "arc"), scratch(spark, "warc")
    write_arc(arcs, legacy)
    stored = read_arc(spark, legacy)
    marks = materialise(revisits(convert(stored, payload=False), least), "revisits")
    write(convert(stored).join(marks, "record_id", "left"), path, each_bytes)
    delete(spark, legacy)
    return read(spark, path)
