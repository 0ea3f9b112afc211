"""Legacy ARC archives converted to WARC, written with Spark's own writer and read back by declared lengths."""
from __future__ import annotations

import gzip
import io
import uuid
from base64 import b32encode
from collections.abc import Iterator
from hashlib import sha1
from typing import IO
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanquarry.llm.shared import cut, folder, small_batches

_URL_SAFE = "".join(chr(c) for c in range(33, 127))
#: The field lines of the two ARC versions.
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length",
          2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
HELD = 1 << 23  # bytes of payload that a worker gathers before it hands them on
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return b32encode(sha1(payload).digest()).decode()


def arc_record(version: int, url: str, date: str, kind: str, body: bytes, ip: str = "0.0.0.0", name: str = "-") -> bytes:
    extra = "" if version == 1 else f" 200 - - 0 {name}"
    return f"{quote(url, safe=_URL_SAFE) or '-'} {ip} {date} {kind}{extra} {len(body)}\n".encode() + body + b"\n"


def pages_to_arc(pages: DataFrame, records: int = 256, date: str = "20000101000000") -> DataFrame:
    """``name, content``: ARC archives, version 1 and 2 in turn, in the layout of Spark's binary file source.

    An archive ends after ``records`` pages, or sooner with the page that brings it to ``HELD`` bytes. The page's id
    travels as an HTTP header. Null html is an empty payload, a null url ``-``, a null id an empty header."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, parts, held = 0, [], 0
        for b in batches:
            for page, url, html in b.itertuples(index=False):
                version, name = 1 + n % 2, f"part-{n}.arc"
                if not parts:
                    head = f"{version} 0 spanquarry\n{FIELDS[version]}\n".encode()
                    parts = [arc_record(1, f"filedesc://{name}", date, "text/plain", head)]
                payload = (html or "").encode("utf-8", "replace")
                http = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if pd.isna(page) else int(page)}\r\nContent-Length: {len(payload)}\r\n\r\n"
                parts.append(arc_record(version, url or "", date, "text/html", http.encode() + payload, name=name))
                held += len(payload)
                if len(parts) > records or held > HELD:
                    yield pd.DataFrame({"name": [name], "content": [b"".join(parts)]})
                    n, parts, held = n + 1, [], 0
        if parts:
            yield pd.DataFrame({"name": [f"part-{n}.arc"], "content": [b"".join(parts)]})

    return pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html").mapInPandas(build, "name string, content binary")


def _opened(content: bytes) -> IO[bytes]:
    """A plain or gzip file, inflated as it is read."""
    return gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def parse_arc(content: bytes) -> Iterator[dict]:
    """Records of an ARC file (plain or gzip), by its version's header lines and the declared lengths.

    The version block names the version and its fields; without one version 1 holds. Blank lines between records are
    skipped; a line that is no header (other number of fields, no length) is skipped as well, a record that the file
    ends in is dropped.
    """
    data = _opened(content)
    fields = FIELDS[1].split()
    while line := data.readline():
        parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        described = parts[0].startswith("filedesc://")
        names = FIELDS[1].split() if described and len(parts) == 5 else fields
        if len(parts) != len(names) or not parts[-1].isdigit():
            continue
        body = data.read(int(parts[-1]))
        if len(body) < int(parts[-1]):
            return
        if described:
            first, _, rest = body.partition(b"\n")
            named = rest.partition(b"\n")[0].decode("utf-8", "replace").split()
            fields = named if named and named[-1] == "Archive-length" else FIELDS[2 if first[:1] == b"2" else 1].split()
            continue
        yield dict(zip(names, parts)) | {"body": body}


def warc_date(date: str) -> str:
    """ISO time of a 14-digit (or shorter) ARC date; what is missing or wrong counts from the year 1970."""
    d = date if date.isdigit() and 4 <= len(date) <= 14 else "1970"
    d += "19700101000000"[len(d):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, key: str, digest: str = "") -> str:
    """Records that differ in url, time, key or payload have ids of their own."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {key} {digest}')}>"


def http_parts(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """Header, payload and header fields of an HTTP response; a block without one is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block, {}
    head, mark, payload = block.partition(b"\r\n\r\n")
    pairs = (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])
    return head + mark, payload, {k.strip().lower(): v.strip() for k, _, v in pairs}


_RECORD = "page_id string, url string, ip string, date string, record_id string, digest string, size long, head binary, payload binary"


def convert(archives: DataFrame) -> DataFrame:
    """One row a record of the archives (``content``), with its synthetic WARC id, time and payload digest."""
    names = [c.split()[0] for c in _RECORD.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                out, held = [], 0
                for r in parse_arc(content):
                    head, payload, fields = http_parts(r["body"])
                    key, digest = fields.get("x-page-id", ""), digest_of(payload)
                    date = warc_date(r["Archive-date"])
                    out.append((key, r["URL"], r["IP-address"], date, record_id(r["URL"], date, key, digest), digest, len(payload), head, payload))
                    held += len(payload)
                    if held > HELD:
                        yield pd.DataFrame(out, columns=names)
                        out, held = [], 0
                if out:
                    yield pd.DataFrame(out, columns=names)

    return archives.select("content").mapInPandas(rows, _RECORD).withColumn("page_id", F.expr("try_cast(page_id as bigint)"))


def with_types(records: DataFrame, least: int = 0) -> DataFrame:
    """Add ``origin_id, origin_url``: of the record that this one revisits; null for responses.

    Of records with equal payloads of at least ``least`` bytes the one with the largest page_id is the response (ties:
    the largest record id; null ids come last, so one of them is the response where no other is). Rows alike in url,
    page_id and payload are one record: they have one id and one type.
    Only digests and ids are grouped, from a table of their own; payloads travel once, to meet the type of their record.
    """
    slim = cut(records.where(F.col("size") >= least).select("digest", "page_id", "record_id", "url"))
    origins = slim.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "record_id", "url")).alias("o")).where("n > 1").select("digest", "o")
    types = (slim.join(origins, "digest").where(F.col("record_id") != F.col("o.record_id"))
             .select("record_id", F.col("o.record_id").alias("origin_id"), F.col("o.url").alias("origin_url")).dropDuplicates(["record_id"]))
    return records.join(types, "record_id", "left")


def warc_record(r) -> bytes:
    revisit = r.origin_id is not None
    block = r.head if revisit else r.head + r.payload
    kind = "application/http; msgtype=response" if r.head else "application/octet-stream"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response' if r.head else 'resource'}", f"WARC-Record-ID: {r.record_id}", f"WARC-Date: {r.date}", f"WARC-Target-URI: {r.url}",
             f"WARC-IP-Address: {r.ip}", f"WARC-Payload-Digest: sha1:{r.digest}", f"WARC-Block-Digest: sha1:{digest_of(block)}", f"Content-Type: {kind}", f"Content-Length: {len(block)}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {r.origin_id}", f"WARC-Refers-To-Target-URI: {r.origin_url}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def write_warc(records: DataFrame, path: str, per_file: int = 1000) -> None:
    """Gzip WARC files of ``per_file`` records and a warcinfo record each, through Spark's committer.

    Spark's text sink writes a value's bytes as they are; its line end is the blank line that ends a record.
    """
    info = b"software: spanquarry\r\nformat: WARC File Format 1.1"
    lead = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id('warcinfo', '', '')}\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        for b in batches:
            for lo in range(0, len(b), 64):
                out = []
                for r in b.iloc[lo:lo + 64].itertuples(index=False):
                    out += [lead, warc_record(r)] if n % per_file == 0 else [warc_record(r)]
                    n += 1
                yield pd.DataFrame({"value": out})

    (records.mapInPandas(build, "value binary").select(F.col("value").cast("string").alias("value"))
     .write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
     .option("maxRecordsPerFile", per_file + 1).text(path))


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    data = _opened(content)
    while line := data.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := data.readline().rstrip(b"\r\n")):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        yield fields, data.read(int(fields.get("content-length", "0")))


def read_warc(spark, path: str) -> DataFrame:
    """One row a response, resource or revisit of the archives below ``path``; sizes and digests are those of the full payload."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                out = []
                for fields, block in parse_warc(content):
                    if fields.get("warc-type") not in ("response", "resource", "revisit"):
                        continue
                    _, payload, http = http_parts(block)
                    revisit, key = fields["warc-type"] == "revisit", http.get("x-page-id", "")
                    out.append((key, int(http.get("content-length", "0")) if revisit else len(payload),
                                fields["warc-payload-digest"].removeprefix("sha1:") if revisit else digest_of(payload), "revisit" if revisit else "response",
                                fields["warc-record-id"], fields.get("warc-refers-to")))
                if out:
                    yield pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "origin_id"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(rows, "page_id string, payload_bytes long, payload_digest string, record_type string, record_id string, origin_id string").withColumn(
        "page_id", F.expr("try_cast(page_id as bigint)"))


def archive_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages as ARC archives, converted, written as WARC to the shared folder and read back: ``page_id, payload_bytes,
    payload_digest, record_type, refers_to``, one row a page.

    Defined results: null html is an empty payload, which empty pages share; a null page_id stays null, and a revisit of
    such a response refers to null; rows that share a page_id but not url or payload are records of their own; rows that
    repeat are read back as often, with one type. Other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    small_batches(spark)
    path = folder(spark, "warc")
    write_warc(with_types(convert(pages_to_arc(pages)), least), path)
    back = read_warc(spark, path)
    revisited = back.where("origin_id is not null").select("origin_id").distinct()
    named = back.where("record_type = 'response'").select(F.col("record_id").alias("origin_id"), F.col("page_id").alias("refers_to")).join(revisited, "origin_id").dropDuplicates(["origin_id"])
    return back.join(named, "origin_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
