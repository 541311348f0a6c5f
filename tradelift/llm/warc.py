"""From legacy ARC archives to WARC.

An ARC file starts with a version block (`filedesc://...`) that says which version its record headers follow: version 1 has five fields in a line,
version 2 ten. A record is its header line, as many bytes as the line declares, and a line feed. The converter reads the lines, takes
the declared bytes and writes for each a WARC/1.1 record with an identifier, an ISO date, a type and digests made from what
the archive holds. Records of equal payload become revisits of the first.

Archives are files of the shared folder, written by Spark's text writer (the values are bytes, the separator is what
ends a record of the format) and read as binary files, one archive in memory at a time; `size` bounds an archive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tradelift.llm.common import cut, shared_path

#: Bytes after which the next record starts a new archive, and bytes of records given to Spark at once.
SIZE, AT_ONCE = 1 << 24, 1 << 22
#: Payloads below this many bytes are never revisits.
LEAST = 100
#: The fields of a record header by version.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
#: When pages without a date of their own were archived.
DATE = "20240101000000"
_NO_FIELD = re.compile(rb"[\x00-\x20\x7f]")


# ---------------------------------------------------------------- ARC

def _arc_header(version: int, url: bytes, kind: bytes, body: bytes, name: bytes, date: bytes, offset: int) -> bytes:
    """A header line. Field values hold no white space, so what a URL has of it is escaped; an empty one is `-`."""
    url = _NO_FIELD.sub(lambda m: b"%%%02X" % m[0][0], url) or b"-"
    if version == 1:
        return b"%b 0.0.0.0 %b %b %d\n" % (url, date, kind, len(body))
    return b"%b 0.0.0.0 %b %b 200 %08x - %d %b %d\n" % (url, date, kind, zlib.crc32(body), offset, name, len(body))


def _version_block(version: int, name: bytes, date: bytes) -> bytes:
    body = b"%d 0 example\n%b\n" % (version, " ".join(FIELDS[version]).encode())
    line = b"filedesc://%b 0.0.0.0 %b text/plain" % (name, date)
    return line + (b" " if version == 1 else b" 200 - - 0 %b " % name) + b"%d\n" % len(body) + body


def _flushed(rows: list, shape: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(shape), shape)], schema=shape)


_VALUES = pa.schema([("archive", pa.int64()), ("n", pa.int32()), ("value", pa.large_binary())])


def _arc_records(size: int, date: bytes):
    def run(batches):
        top = TaskContext.get().partitionId() << 32
        archive, at, n, rows, held = 0, size, 0, [], 0
        for batch in batches:
            for page, url, html in zip(batch.column("page_id"), batch.column("url").cast(pa.large_binary()), batch.column("html").cast(pa.large_binary())):
                payload = html.as_py() or b""
                page = page.as_py()
                if at >= size:
                    archive, n = archive + 1, 0
                    version, name = 1 + archive % 2, b"pages-%d.arc" % (top + archive)
                    block = _version_block(version, name, date)
                    rows.append((top + archive, 0, block))
                    at = len(block) + 1
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"" if page is None else b"X-Page-Id: %d\r\n" % page) + b"Content-Length: %d\r\n\r\n" % len(payload)
                body = head + payload
                value = _arc_header(version, url.as_py() or b"", b"text/html", body, name, date, at) + body
                n += 1
                rows.append((top + archive, n, value))
                at, held = at + len(value) + 1, held + len(value)
                if held >= AT_ONCE:
                    yield _flushed(rows, _VALUES)
                    rows, held = [], 0
        yield _flushed(rows, _VALUES)
    return run


def _write(records: DataFrame, path: str, end: str) -> None:
    """Records (archive, n, value) as files, one for each archive, in the order of n, each ended by `end`. They are packed at gzip's fastest level."""
    ordered = records.sortWithinPartitions("archive", "n").select("archive", F.col("value").cast("string").alias("value"))
    ordered.write.partitionBy("archive").option("lineSep", end).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def write_arc(pages: DataFrame, path: str, size: int = SIZE, date: str = DATE) -> None:
    """ARC files below `path` of the rows of `pages` (page_id, url, html), versions 1 and 2 in turn. The body of a record is an HTTP reply with
    the page's id among its headers and the html's bytes (null: none). Other columns are not read; no rows give no file."""
    made = pages.select("page_id", "url", "html").mapInArrow(_arc_records(size, date.encode()), "archive bigint, n int, value binary")
    _write(made, path, "\n")


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, bytes], bytes]]:
    """(fields, body) of the records of an ARC file, the version block first. A header that lacks fields, or a length beyond the file, is an error:
    a record that cannot be read whole is never left out in silence."""
    at, fields = 0, FIELDS[1]
    while at < len(data):
        if data[at:at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at:end if end >= 0 else len(data)].rstrip(b"\r")
        parts = line.split(b" ")
        first = parts[0].startswith(b"filedesc://")
        if first and len(parts) in map(len, FIELDS.values()):
            fields = next(f for f in FIELDS.values() if len(f) == len(parts))
        # a content type may hold spaces: what is too much stands there
        extra = len(parts) - len(fields)
        if end < 0 or extra < 0 or not parts[-1].isdigit():
            raise ValueError(f"not an ARC header at byte {at}: {line[:200]!r}")
        kind = fields.index("Content-type")
        parts[kind:kind + extra + 1] = [b" ".join(parts[kind:kind + extra + 1])]
        length = int(parts[-1])
        body = data[end + 1:end + 1 + length]
        if len(body) < length:
            raise ValueError(f"{length} bytes declared at byte {at}, {len(body)} left")
        if first:
            version = int(body.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            fields = FIELDS[version]
        yield dict(zip(fields, parts)), body
        at = end + 1 + length


# ---------------------------------------------------------------- WARC

def _iso(date: bytes) -> str:
    """The 14 digits of an ARC date, or its first 8, 10 or 12, as a WARC date."""
    d = date.decode("ascii", "replace")
    if not d.isdigit() or not 8 <= len(d) <= 14 or len(d) % 2:
        raise ValueError(f"not an ARC date: {d!r}")
    d = d.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _split_http(body: bytes) -> tuple[bytes, bytes]:
    """Head of an HTTP reply, with its empty line, and payload; no head where the body is none."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    end = body.find(b"\r\n\r\n")
    return (body, b"") if end < 0 else (body[:end + 4], body[end + 4:])


def _header(head: bytes, name: bytes) -> bytes | None:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name:
            return value.strip()
    return None


def _number(value: bytes | None) -> int | None:
    return int(value) if value is not None and re.fullmatch(rb"-?\d+", value) else None


def _record_id(fields: dict[str, bytes], body: bytes, archive: int, n: int) -> str:
    """An identifier that a record gets anew in every run: a version 8 UUID of where and what it is."""
    h = hashlib.sha256(b"%d %d " % (archive, n) + b" ".join(fields.values()) + hashlib.sha256(body).digest()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-8{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


def _unzipped(content: bytes) -> bytes:
    """The bytes of a file of one or more gzip members, or as they are."""
    out = []
    while content[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        out += [z.decompress(content), z.flush()]
        content = z.unused_data
    return b"".join([*out, content])


_FACTS = pa.schema([("archive", pa.int64()), ("n", pa.int32()), ("id", pa.string()), ("page_id", pa.int64()), ("bytes", pa.int64()), ("digest", pa.string()), ("uri", pa.string()), ("date", pa.string())])


def _facts(batches):
    """What the records of archives hold, without their bodies."""
    for batch in batches:
        for archive, content in zip(batch.column("archive").to_pylist(), batch.column("content")):
            rows = []
            for n, (fields, body) in enumerate(parse_arc(_unzipped(content.as_py()))):
                head, payload = _split_http(body)
                if n and head:
                    rows.append((archive, n, _record_id(fields, body, archive, n), _number(_header(head, b"x-page-id")), len(payload), _sha(payload), fields["URL"].decode("utf-8", "replace"), _iso(fields["Archive-date"])))
            yield _flushed(rows, _FACTS)


def _warc_record(kind: str, uri: str, date: str, name: str, mime: str, block: bytes, more: list[tuple[str, str]]) -> bytes:
    lines = [("WARC-Type", kind), *([("WARC-Target-URI", uri)] if uri else []), ("WARC-Date", date), ("WARC-Record-ID", name), ("Content-Type", mime), *more,
             ("WARC-Block-Digest", f"sha256:{_sha(block)}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block


def _converted(batches):
    """WARC records (archive, n, value) of archives (archive, content, revisits)."""
    for batch in batches:
        for archive, content, revisits in zip(batch.column("archive").to_pylist(), batch.column("content"), batch.column("revisits").to_pylist()):
            known, rows, held = {r["n"]: r for r in revisits or ()}, [], 0
            for n, (fields, body) in enumerate(parse_arc(_unzipped(content.as_py()))):
                uri, date, name = fields["URL"].decode("utf-8", "replace"), _iso(fields["Archive-date"]), _record_id(fields, body, archive, n)
                head, payload = _split_http(body)
                if n == 0 and uri.startswith("filedesc://"):
                    info = f"software: arc converter\r\nformat: WARC File Format 1.1\r\nisPartOf: {uri[11:]}\r\n".encode()
                    value = _warc_record("warcinfo", "", date, name, "application/warc-fields", info, [("WARC-Filename", f"{uri[11:]}.warc")])
                elif not head:
                    value = _warc_record("resource", uri, date, name, fields["Content-type"].decode("utf-8", "replace"), body, [("WARC-Payload-Digest", f"sha256:{_sha(body)}")])
                else:
                    digest, first = [("WARC-Payload-Digest", f"sha256:{_sha(payload)}")], known.get(n)
                    if first:
                        digest += [("WARC-Refers-To", first["id"]), ("WARC-Refers-To-Target-URI", first["uri"]), ("WARC-Refers-To-Date", first["date"]),
                                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                    value = _warc_record("revisit" if first else "response", uri, date, name, "application/http; msgtype=response", head if first else body, digest)
                rows.append((archive, n, value))
                held += len(value)
                if held >= AT_ONCE:
                    yield _flushed(rows, _VALUES)
                    rows, held = [], 0
            yield _flushed(rows, _VALUES)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, content) of the files below `path`, numbered by their folder where it has the number, else by a hash of their place."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    own = F.regexp_extract("path", r"archive=(\d+)", 1)
    return files.select(F.coalesce(own.try_cast("bigint"), F.xxhash64("path")).alias("archive"), "content")


def convert(spark: SparkSession, arc: str, warc: str, least: int = LEAST) -> None:
    """WARC files below `warc` of the ARC files below `arc`, one for each.

    The version block becomes a warcinfo record, an HTTP reply a response, anything else a resource. Of replies with equal payloads of at least
    `least` bytes the one with the smallest page id (none is larger than any; then by archive and place) is the response; the others are revisits of it that
    keep their HTTP head and the payload's digest. Only digests and ids are shuffled, and equal ones meet in a minimum that combines first; an archive's list of revisits then joins its bytes."""
    archives = _archives(spark, arc)
    facts = cut(archives.mapInArrow(_facts, "archive bigint, n int, id string, page_id bigint, bytes bigint, digest string, uri string, date string"))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "archive", "n", "id", "uri", "date")
    first = facts.where(F.col("bytes") >= least).groupBy("digest").agg(F.count("*").alias("many"), F.min(order).alias("first")).where("many > 1").select("digest", "first")
    again = facts.join(first, "digest").where("id <> first.id").select("archive", F.struct("n", "first.id", "first.uri", "first.date").alias("r"))
    again = cut(again.groupBy("archive").agg(F.collect_list("r").alias("revisits")))
    made = archives.join(again, "archive", "left").mapInArrow(_converted, "archive bigint, n int, value binary")
    _write(made, warc, "\r\n\r\n")


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of the records of a WARC file."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record at byte {at}")
        head = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        length = int(head["content-length"])
        block = data[end + 4:end + 4 + length]
        if len(block) < length or data[end + 4 + length:end + 8 + length] != b"\r\n\r\n":
            raise ValueError(f"{length} bytes declared at byte {at} do not end a record")
        yield head, block
        at = end + 8 + length


_READ = pa.schema([("archive", pa.int64()), ("type", pa.string()), ("id", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()), ("page_id", pa.int64()),
                   ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("sound", pa.bool_())])


def _read(batches):
    for batch in batches:
        for archive, content in zip(batch.column("archive").to_pylist(), batch.column("content")):
            rows = []
            for head, block in parse_warc(_unzipped(content.as_py())):
                kind, said = head["warc-type"], head.get("warc-payload-digest", "").removeprefix("sha256:")
                http, payload = _split_http(block) if kind in ("response", "revisit") else (b"", block)
                gone = kind == "revisit"
                size, digest = (_number(_header(http, b"content-length")), said) if gone else (len(payload), _sha(payload))
                sound = head["warc-block-digest"] == f"sha256:{_sha(block)}" and (not said or digest == said)
                rows.append((archive, kind, head["warc-record-id"], head.get("warc-target-uri"), head["warc-date"], head.get("warc-refers-to"), _number(_header(http, b"x-page-id")), size, digest, sound))
            yield _flushed(rows, _READ)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """archive, type, id, uri, date, refers_to (an id), page_id, payload_bytes, payload_digest and sound (whether the digests hold) of every record below `path`. Size and digest are
    those of the whole payload: of a revisit, what its HTTP head and its record say."""
    return _archives(spark, path).mapInArrow(_read, "archive bigint, type string, id string, uri string, date string, refers_to string, page_id bigint, payload_bytes bigint, payload_digest string, sound boolean")


def archived(pages: DataFrame, size: int = SIZE, least: int = LEAST) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to (the page_id of a revisit's response) of every row of `pages` (page_id, url, html), read
    back from WARC files that were converted from ARC files of the rows.

    A null html has an empty payload, a null page_id or url stands for none, repeated rows are records apart: one is the response and the others revisit it, if their payload is
    large enough. No rows give none. A record whose digests do not hold is an error."""
    spark = pages.sparkSession
    arc, warc = shared_path(spark, "arc"), shared_path(spark, "warc")
    write_arc(pages, arc, size)
    convert(spark, arc, warc, least)
    read = cut(read_warc(spark, warc).where("type in ('response', 'revisit')"))
    told = F.assert_true(F.col("sound"), F.lit("a record's digest does not hold"))
    targets = read.where("type = 'response'").select(F.col("id").alias("refers_to"), F.col("page_id").alias("target"))
    out = read.where(told.isNull()).join(targets, "refers_to", "left")
    return out.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("target").alias("refers_to"))
