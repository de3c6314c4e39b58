"""Legacy web archives (ARC) and their conversion to WARC.

An ARC file starts with a version block, ``filedesc://...``, whose second line
names the version; the last line of the block lists the fields of a record's
header line: five for version 1, ten for version 2.  The header line ends with
the record's length in bytes.  Files are sequences of gzip members, one a record.

``convert`` reads such a file and writes a WARC/1.1 file: an identifier made
from the record's own data (the same for each attempt), the time from the ARC
date, the type from what is to become of it, SHA-256 digests of block and
payload.  A payload that an earlier record holds becomes a ``revisit`` of that
record and keeps the HTTP header only.

Pages are dealt to archives by a hash, which also splits rows that are all alike:
about ``PAGES`` pages or ``ARC_BYTES`` each, whichever are more archives.  Archives are
written, converted and read in as many tasks, ``MOST_TASKS`` at most.  Executors
write archives to the shared folder by a rename, under names that don't depend on
the attempt, and are never asked for what they wrote before: a lost executor
costs the repetition of its archives.

Defined results: a null html is an empty payload, a null url ``urn:unknown``;
rows without a page_id are kept, with a null page_id; rows of one page_id are
records each, of which one (the smaller archive position) is the response if
their payloads are equal; an empty table gives no archives and no rows; other
columns aren't read.
"""

from __future__ import annotations

import datetime
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import MOST_TASKS, Scratch, drop_written, fresh_dir, materialize
from rasterloom.llm.tokens import get_file, put_file

#: Header fields by version (fixed values of the format).
FIELDS = {
    "1": ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    "2": ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are never revisits.
LEAST = 100
#: Pages of an archive on average.
PAGES = 2048
#: And bytes of html.
ARC_BYTES = 64 << 20


@dataclass
class ArcRecord:
    fields: dict[str, str]
    block: bytes
    offset: int = 0
    version: str = "1"

    @property
    def http(self) -> tuple[bytes, bytes]:
        """(header with its blank line, payload)."""
        at = self.block.find(b"\r\n\r\n")
        if not self.block.startswith(b"HTTP/") or at < 0:
            return b"", self.block
        return self.block[: at + 4], self.block[at + 4 :]


def member(raw: bytes) -> bytes:
    """One gzip member, without a time, so that equal records make equal files."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def bare(text: str) -> str:
    """Without what would end a header field or line."""
    return re.sub(r"[\s\x00-\x1f]", lambda m: f"%{ord(m[0]):02X}" if ord(m[0]) < 256 else "%20", text) or "-"


def arc_version_block(version: str, name: str, date: str) -> bytes:
    body = f"{version} 0 rasterloom\n{' '.join(FIELDS[version])}\n\n".encode()
    head = [f"filedesc://{name}", "0.0.0.0", date, "text/plain"]
    if version == "2":
        head += ["200", "-", "-", "0", name]
    return f"{' '.join(head)} {len(body)}\n".encode() + body


def arc_record(version: str, url: str, date: str, block: bytes, offset: int = 0, name: str = "-") -> bytes:
    head = [bare(url), "0.0.0.0", date, "text/html"]
    if version == "2":
        head += ["200", hashlib.sha256(block).hexdigest(), "-", str(offset), name]
    return f"{' '.join(head)} {len(block)}\n".encode() + block + b"\n"


def read_arc(raw: bytes) -> Iterator[ArcRecord]:
    """Records in order; the version block says how header lines are read, lengths where records end."""
    data = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    at, names, version = 0, FIELDS["1"], "1"
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            break
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        if not line:
            at = end + 1
            continue
        parts = line.split(" ")
        first = line.startswith("filedesc://")
        want = FIELDS["2" if len(parts) >= len(FIELDS["2"]) else "1"] if first else names
        if len(parts) < len(want):
            raise ValueError(f"a header line of {len(parts)} fields, not {len(want)}, at {at}")
        extra = len(parts) - len(want)  # a URL with blanks in it
        values = [" ".join(parts[: extra + 1]), *parts[extra + 1 :]]
        fields = dict(zip(want, values, strict=True))
        size = int(fields["Archive-length"])
        block = data[end + 1 : end + 1 + size]
        if len(block) < size:
            raise ValueError(f"a record at {at} declares {size} bytes and has {len(block)}")
        if first:
            lines = block.decode("utf-8", "replace").splitlines()
            version = lines[0].split(" ")[0] if lines else "1"
            names = tuple(lines[1].split(" ")) if len(lines) > 1 and lines[1].strip() else FIELDS[version]
        else:
            yield ArcRecord(fields, block, at, version)
        at = end + 1 + size


@dataclass
class WarcRecord:
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    def dump(self) -> bytes:
        head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in self.headers.items()) + f"Content-Length: {len(self.block)}\r\n\r\n"
        return head.encode() + self.block + b"\r\n\r\n"


def read_warc(raw: bytes) -> Iterator[WarcRecord]:
    data = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record at {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers.pop("Content-Length"))
        yield WarcRecord(headers, data[end + 4 : end + 4 + size])
        at = end + 4 + size + 4


def http_field(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*(.*?)\r?$", head)
    return m[1].decode() if m else None


def identifier(url: str, date: str, key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {key}')}>"


def warc_of(arc: ArcRecord, first: dict | None = None) -> WarcRecord:
    """``first``: id, url and date of the record that holds the payload, if this is a revisit."""
    head, payload = arc.http
    url, day = arc.fields["URL"], arc.fields["Archive-date"]
    when = datetime.datetime.strptime(day.ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    block = head if first else arc.block
    h = {
        "WARC-Type": "revisit" if first else "response" if head else "resource",
        "WARC-Record-ID": identifier(url, day, http_field(head, "X-Archive-Key") or str(arc.offset)),
        "WARC-Date": when,
        "WARC-Target-URI": url,
        "WARC-IP-Address": arc.fields["IP-address"],
        "Content-Type": "application/http; msgtype=response" if head else arc.fields["Content-type"],
        "WARC-Payload-Digest": f"sha256:{hashlib.sha256(payload).hexdigest()}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
    }
    if first:
        h |= {"WARC-Profile": REVISIT, "WARC-Refers-To": first["id"], "WARC-Refers-To-Key": first["key"]}
    return WarcRecord(h, block)


def convert(raw: bytes, firsts: dict[str, dict] | None = None, info: bytes = b"software: rasterloom\r\nformat: WARC File Format 1.1\r\n") -> bytes:
    """An ARC file's records as a WARC file; ``firsts``: by the records' keys, what they are revisits of."""
    out = []
    for r in read_arc(raw):
        if not out:
            out.append(member(WarcRecord({"WARC-Type": "warcinfo", "WARC-Record-ID": identifier("warcinfo", r.fields["Archive-date"], r.fields["URL"]), "WARC-Date": "1970-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, info).dump()))
        key = http_field(r.http[0], "X-Archive-Key") or str(r.offset)
        out.append(member(warc_of(r, (firsts or {}).get(key)).dump()))
    return b"".join(out)


# ---- pages ------------------------------------------------------------------

DATE = "20240101000000"


def write_arcs(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", per_file: int = PAGES, scratch: Scratch | None = None) -> DataFrame:
    """Write the pages as ARC files of both versions; returns their index (arc, key, page_id, url, bytes, digest), which goes with ``scratch``."""
    size = pages.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col(html_col).cast("string"))), F.lit(0)).alias("b")).first()
    files = max(1, -(-size["n"] // per_file), -(-size["b"] // ARC_BYTES))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("urn:unknown")).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("arc", F.pmod(F.xxhash64("page_id", "url", F.monotonically_increasing_id()), F.lit(files)))

    def run(key, t):
        arc = key[0].as_py()
        t = t.sort_by([("page_id", "ascending"), ("url", "ascending"), ("html", "ascending")])
        version, name = "12"[arc % 2], f"pages-{arc:08d}.arc.gz"
        out, at, index = [member(arc_version_block(version, name, DATE))], 0, []
        for n, (page, url, html) in enumerate(zip(t.column("page_id").to_pylist(), t.column("url").to_pylist(), t.column("html").to_pylist(), strict=True)):
            payload = html.encode()
            k = f"{arc}.{n}"
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {'' if page is None else page}\r\nX-Archive-Key: {k}\r\n\r\n".encode()
            raw = arc_record(version, url, DATE, head + payload, at, name)
            at += len(raw)
            out.append(member(raw))
            index.append((arc, k, page, url, len(payload), hashlib.sha256(payload).hexdigest()))
        put_file(f"{folder}/{name}", b"".join(out))
        cols = zip(*index, strict=True)
        return pa.table(dict(zip(("arc", "key", "page_id", "url", "bytes", "digest"), [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)], strict=True)))

    dealt = rows.repartition(min(files, MOST_TASKS), "arc")
    return (scratch.keep if scratch else materialize)(dealt.groupBy("arc").applyInArrow(run, "arc long, key string, page_id long, url string, bytes long, digest string"), "arc-index")


def first_holders(index: DataFrame, least: int = LEAST) -> DataFrame:
    """(arc, key, of): of every record whose payload an earlier page holds, that page's record."""
    big = index.where(F.col("bytes") >= least)
    order = F.struct(F.col("page_id").isNull(), "page_id", "key")
    holder = big.groupBy("digest").agg(F.min_by(F.struct("key", "url", "page_id"), order).alias("of"), F.count("*").alias("n")).where(F.col("n") > 1).select("digest", "of")
    return big.select("arc", "key", "digest").join(holder, "digest").where(F.col("key") != F.col("of.key")).select("arc", "key", "of")


def convert_arcs(index: DataFrame, folder: str, to: str | None = None) -> DataFrame:
    """Convert every ARC file of the index into ``to``, or beside it; returns (path, size), materialised."""
    to = to or folder
    tasks = max(1, min(index.agg(F.max("arc")).first()[0] or 0, MOST_TASKS - 1) + 1)
    revisits = first_holders(index).select("arc", "key", F.col("of.key").alias("of_key"), F.col("of.url").alias("of_url"), F.col("of.page_id").alias("of_page"))
    todo = index.select("arc", F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("of_key"), F.lit(None).cast("string").alias("of_url"), F.lit(None).cast("long").alias("of_page")).distinct().unionByName(revisits)

    def run(key, pdf):
        arc = int(key[0])
        own = pdf[pdf["key"].notna()]
        firsts = {k: {"id": identifier(bare(u), DATE, o), "key": "" if pd.isna(p) else str(int(p))} for k, o, u, p in zip(own["key"], own["of_key"], own["of_url"], own["of_page"], strict=True)}
        raw = convert(get_file(f"{folder}/pages-{arc:08d}.arc.gz"), firsts)
        path = f"{to}/pages-{arc:08d}.warc.gz"
        put_file(path, raw)
        return pd.DataFrame({"path": [path], "size": [len(raw)]})

    return materialize(todo.repartition(tasks, "arc").groupBy("arc").applyInPandas(run, "path string, size long"), "warcs")


def read_warcs(files: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: int(x) if x else None
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                for r in read_warc(get_file(path)):
                    kind = r.headers["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    at = r.block.index(b"\r\n\r\n") + 4
                    head, payload = r.block[:at], r.block[at:]
                    told = r.headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    if r.headers["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(r.block).hexdigest()}" or kind == "response" and hashlib.sha256(payload).hexdigest() != told:
                        raise ValueError(f"{path}: a digest doesn't match")
                    size = int(http_field(head, "Content-Length")) if kind == "revisit" else len(payload)
                    rows.append((number(http_field(head, "X-Page-Id")), size, told, kind, number(r.headers.get("WARC-Refers-To-Key"))))
                cols = zip(*rows, strict=True) if rows else [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    dealt = files.select("path").repartition(max(1, min(files.count(), MOST_TASKS)), "path")
    return dealt.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, **cols) -> DataFrame:
    """Pages to ARC files, those to WARC files, and what these hold; only the WARC files stay."""
    spark = pages.sparkSession
    old, new = fresh_dir(spark, "arc"), fresh_dir(spark, "warc")
    with Scratch() as scratch:
        index = write_arcs(pages, old, scratch=scratch, **cols)
        files = convert_arcs(index, old, new)
        drop_written(spark, old)
    return read_warcs(files)
