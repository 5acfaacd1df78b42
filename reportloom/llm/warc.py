"""Legacy ARC to WARC: writer and reader of ARC blocks, the converter, and WARC archives in the shared folder.

ARC header lines differ by version: version 1 has five fields, version 2 ten; the version block at the head of a file
says which. Both end in the record's declared length, which alone says where a record ends. From each header line the
converter makes the WARC record's identifier, timestamp, type, target and digests.

Archives are written by Spark's text writer: a record is one value, and the record separator of the format, two line
ends, is the writer's line separator; so any file system that Spark writes to can hold them. They are read back as whole
files of at most ``RECORDS_A_FILE`` records and parsed by declared lengths.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportloom.llm.cluster import shared_dir

#: Field names of the header lines by version, as the version block states them. Fixed values.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORDS_A_FILE = 4000
#: Payloads below so many bytes are always stored in full.
LEAST_REVISIT = 100
READ = "page_id long, url string, warc_date string, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def version_block(version: int, name: str = "legacy.arc", date: str = "20000101000000") -> bytes:
    """The first record of an ARC file."""
    body = f"{version} 0 reportloom\n{FIELDS[version]}\n\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {date} text/plain" + (" 200 - - 0 " + name if version == 2 else "") + f" {len(body)}\n"
    return line.encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, kind: str, block: bytes, ip: str = "0.0.0.0", status: int = 200, name: str = "legacy.arc") -> bytes:
    extra = f" {status} {hashlib.md5(block).hexdigest()} - 0 {name}" if version == 2 else ""
    return f"{url} {ip} {date} {kind}{extra} {len(block)}\n".encode() + block + b"\n"


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record. URLs may hold spaces: the other fields are split off from the right.

    A record whose header line cannot be read or whose declared length runs beyond the file raises ValueError.
    """
    at, fields = 0, FIELDS[1].split()
    while at < len(data):
        end = data.find(b"\n", at)
        if end == at or end == -1 and not data[at:].strip():
            at += 1
            continue
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        if line.startswith("filedesc://"):
            length = int(line.rsplit(" ", 1)[1])
            said = data[end + 1 : end + 1 + length].split(b"\n")
            version = int(said[0].split()[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version}")
            fields = said[1].decode().split()
            parts = line.rsplit(" ", len(FIELDS[version].split()) - 1)
            if len(parts) < len(fields):
                parts = line.rsplit(" ", 4)
                header = dict(zip(FIELDS[1].split(), parts, strict=True))
            else:
                header = dict(zip(fields, parts, strict=True))
        else:
            parts = line.rsplit(" ", len(fields) - 1)
            if len(parts) != len(fields):
                raise ValueError(f"ARC header line {line[:80]!r}")
            header = dict(zip(fields, parts, strict=True))
        length = int(header["Archive-length"])
        if length < 0 or end + 1 + length > len(data):
            raise ValueError("declared length beyond the file")
        yield header, data[end + 1 : end + 1 + length]
        at = end + 1 + length + 1


def warc_date(date: str) -> str:
    """ISO form of 8, 12 or 14 digits."""
    d = (date + "0" * 14)[:14] if len(date) >= 8 else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256('|'.join(map(str, parts)).encode()).digest()[:16], version=4)}>"


def payload_of(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head and payload of a response block."""
    head, gap, rest = block.partition(b"\r\n\r\n")
    return (head + gap, rest) if block.startswith(b"HTTP/") and gap else (b"", block)


def to_warc(header: dict[str, str], block: bytes, extra: dict[str, str], refers: dict[str, str] | None = None, rid: str | None = None) -> bytes:
    """The WARC record for an ARC record, without the closing line ends. With ``refers`` a revisit without payload."""
    url, kind = header["URL"], header["Content-type"]
    head, payload = payload_of(block)
    digest = hashlib.sha256(payload).hexdigest()
    lines = {"WARC-Type": "warcinfo" if url.startswith("filedesc://") else "response" if head else "resource"}
    body = block
    if refers is not None:
        lines["WARC-Type"], body = "revisit", head
        lines["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    lines |= {"WARC-Record-ID": rid or record_id(url, header["Archive-date"], digest), "WARC-Date": warc_date(header["Archive-date"])}
    if not url.startswith("filedesc://"):
        lines |= {"WARC-Target-URI": url, "WARC-IP-Address": header["IP-address"], "WARC-Payload-Digest": f"sha256:{digest}"}
    lines |= {"WARC-Block-Digest": f"sha256:{hashlib.sha256(body).hexdigest()}", "Content-Type": "application/http; msgtype=response" if head else kind} | (refers or {}) | extra
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + f"Content-Length: {len(body)}\r\n\r\n".encode() + body


def read_warc(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a stream, by declared lengths; one record is held at a time."""
    source, data = iter(chunks), b""

    def more() -> bool:
        nonlocal data
        got = next(source, None)
        data += got or b""
        return got is not None

    while True:
        data = data.lstrip(b"\r\n") if len(data) < 1 << 16 else data[len(data) - len(data.lstrip(b"\r\n")) :]
        while (end := data.find(b"\r\n\r\n")) < 0:
            if not more():
                if data.strip():
                    raise ValueError("cut WARC header")
                return
            data = data.lstrip(b"\r\n")
        lines = data[:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {lines[0][:40]!r}")
        header = dict(x.split(": ", 1) for x in lines[1:])
        length = int(header["Content-Length"])
        while len(data) < end + 4 + length:
            if not more():
                raise ValueError("cut WARC block")
        yield header, data[end + 4 : end + 4 + length]
        data = data[end + 4 + length :]


def gunzip(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """Members of a gzip file, a piece at a time."""
    while data:
        z = zlib.decompressobj(31)
        while True:
            out = z.decompress(data, step)
            data = z.unconsumed_tail
            if out:
                yield out
            if z.eof or not data:
                break
        data = z.unused_data


def decide(pages: DataFrame) -> DataFrame:
    """Adds digest, n_bytes, copy and refers_to (null: stored in full) to (page_id, url, html).

    Of equal payloads of at least LEAST_REVISIT bytes the smallest page_id is stored, once; all others refer to it. A row
    without page_id is stored in full and never referred to. The html is shuffled once, by page; a digest that very many
    pages share is looked up from salted parts.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("n_bytes"))
    salts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = rows.where((F.col("n_bytes") >= LEAST_REVISIT) & F.col("page_id").isNotNull()).select("page_id", "digest", F.pmod(F.xxhash64("page_id"), F.lit(salts)).alias("salt"))
    parts = keys.groupBy("digest", "salt").agg(F.min("page_id").alias("low"), F.count("*").alias("n"))
    firsts = parts.groupBy("digest").agg(F.min("low").alias("first"), F.sum("n").alias("n")).where("n > 1").drop("n")
    spread = parts.select("digest", "salt").join(firsts, "digest")
    refs = keys.join(spread, ["digest", "salt"]).groupBy("page_id", "digest").agg(F.min("first").alias("first"))
    copies = Window.partitionBy("page_id", "digest").orderBy("url")
    rows = rows.withColumn("copy", F.row_number().over(copies)).join(refs, ["page_id", "digest"], "left")
    return rows.withColumn("refers_to", F.when((F.col("page_id") != F.col("first")) | (F.col("copy") > 1), F.col("first"))).drop("first")


def archive(pages: DataFrame, version: int = 1, date: str = "20000101000000") -> str:
    """Turns (page_id, url, html) into legacy ARC blocks, converts them and writes WARC archives; returns their folder.

    Null html is an empty payload; a null or empty url becomes urn:page:<page_id>; line ends and outer spaces in a url
    are percent-escaped. An empty table gives a folder without records.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = version_block(version)
        ((header, block),) = read_arc(info)
        yield _strings([to_warc(header, block, {})])
        for batch in batches:
            rows, size = [], 0
            for row in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "digest", "copy", "refers_to")), batch["html"].cast(pa.binary()).to_pylist(), strict=True):
                rows.append(row)
                size += len(row[-1])
                if size > 4 << 20:
                    yield _strings(_converted(rows, info, version, date))
                    rows, size = [], 0
            if rows:
                yield _strings(_converted(rows, info, version, date))

    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    # local work of the converter: nothing is written but the archives themselves
    out = decide(pages).mapInArrow(convert, "value string")
    out.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)
    return path


def _strings(values: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, pa.binary()).view(pa.string())], ["value"])


def _converted(rows: list[tuple], info: bytes, version: int, date: str) -> list[bytes]:
    legacy = [info]
    for page, url, _, _, _, html in rows:
        url = (url or "").strip().replace("\r", "%0D").replace("\n", "%0A") or f"urn:page:{page}"
        head = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
        legacy.append(arc_record(version, url, date, "text/html", head + html))
    out, records = [], read_arc(b"".join(legacy))
    next(records)
    for (page, _, digest, copy, refers, _), (header, block) in zip(rows, records, strict=True):
        extra = {"X-Page-Id": "" if page is None else str(page)}
        back = None if refers is None else {"WARC-Refers-To": record_id(refers, digest, 1), "X-Refers-To-Page-Id": str(refers)}
        out.append(to_warc(header, block, extra, back, record_id(page, digest, copy)))
    return out


def read_archive(spark, path: str) -> DataFrame:
    """One row per response and revisit record of the archives in ``path``, checked against the stated digests."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        types = [pa.int64() if x.endswith("long") else pa.string() for x in READ.split(", ")]
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for header, block in read_warc(gunzip(content.as_py())):
                    if header["WARC-Type"] not in ("response", "revisit"):
                        continue
                    head, payload = payload_of(block)
                    digest = header["WARC-Payload-Digest"].removeprefix("sha256:")
                    stated = int(next(x.split(b":")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")))
                    if header["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != stated):
                        raise ValueError(f"payload of {header['WARC-Record-ID']} does not match its digest")
                    page, refers = header["X-Page-Id"], header.get("X-Refers-To-Page-Id")
                    rows.append((int(page) if page else None, header["WARC-Target-URI"], header["WARC-Date"], header["WARC-Record-ID"], stated, digest, header["WARC-Type"], int(refers) if refers else None))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, READ)
