"""WARC archives packed in ZIP: writing them, and reading records by range without extraction.

An archive is a ZIP file with two stored (uncompressed) members: ``archive/data.warc.gz``, in
which every record is a gzip member of its own, and ``indexes/index.jsonl`` with one line for
each record: its id, offset and length in the former.

Writing: a task packs its pages into archives of about ``ARCHIVE_BYTES`` each, under a name of its
own, in the shared folder, and reports them; the reports are written down once, and only archives
in them count, so a task that is run again leaves an unlisted file at worst. Of pages with equal
payloads of at least ``MIN_REVISIT`` bytes, the one with the largest id is the response and the
others are revisits that refer to it. Which payloads repeat is found from digests alone. Their
table is broadcast while it has at most ``BROADCAST_GROUPS`` rows; beyond that, the join shuffles by
digest and salt.

Reading: from the end of the file, the ZIP (or ZIP64) end record leads to the central directory;
members are found there, the index is read, and each record is fetched by its own range (near
ranges share one request) and unpacked alone. A reader holds a block and a record at a time.

Files are reached through pyarrow's file systems, by the URI of the shared folder. Null html is
an empty payload; a null URL leaves the target header out; a null id is kept as null, and never
named as what a revisit refers to. Repeated rows each get a record (those that tie for the largest
id are all responses). An empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeria.llm.common import new_path, saved, ship, until_exit

DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
ARCHIVE_BYTES, READ_BYTES, LEVEL = 8 << 20, 1 << 20, 4
MIN_REVISIT, BROADCAST_GROUPS, SALTS = 1000, 50_000, 16
DATE = "2024-01-01T00:00:00Z"


def file_system(uri: str):
    """(pyarrow file system, path in it)"""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


# --- records ---------------------------------------------------------------------------------


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, original_bytes: int, sha1: str) -> bytes:
    """A WARC 1.1 response or, with refers_to, a revisit, as one gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {original_bytes}\r\n\r\n".encode()
    body = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127)))))
    if refers_to is not None:
        head.append(f"WARC-Refers-To: {record_id(refers_to)}")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (names in lower case), payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda lines: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    warc = fields(lines)
    body = rest[: int(warc["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return warc, fields(http.decode().split("\r\n")[1:]), payload


def page_of(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return None if number in ("", "null") else int(number)


# --- ZIP -------------------------------------------------------------------------------------


def pack_archive(data: bytes, index: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name, content in ((DATA, data), (INDEX, index)):
            with z.open(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), "w", force_zip64=True) as f:
                f.write(content)
    return out.getvalue()


class Ranges:
    """Reads ranges of a file, a block at a time."""

    def __init__(self, file, size: int | None = None):
        self.file = file
        self.size = file.size() if size is None else size
        self.at, self.block = 0, b""

    def read(self, start: int, n: int) -> bytes:
        if not (self.at <= start and start + n <= self.at + len(self.block)):
            self.file.seek(start)
            self.at, self.block = start, self.file.read(min(max(n, READ_BYTES), self.size - start))
        got = self.block[start - self.at : start - self.at + n]
        if len(got) < n:
            raise ValueError("range beyond the end of the archive")
        return got


# Signatures and layouts of the ZIP format (APPNOTE 4.3).
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def directory(r: Ranges) -> Iterator[tuple[str, int, int, int]]:
    """(name, method, size, offset of the local header) of every member, from the central directory."""
    tail_at = max(0, r.size - (1 << 16) - 22)
    tail = r.read(tail_at, r.size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] > len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end record: not a ZIP file")
    entries, size, start = struct.unpack_from("<HII", tail, at + 10)
    here = tail_at + at
    shift = here - size - start if start != FULL32 and size != FULL32 else 0  # bytes put before the archive
    if FULL16 == entries or FULL32 in (size, start):
        mark, _, at64, _ = struct.unpack("<4sIQI", r.read(here - 20, 20))
        if mark == LOCATOR64:
            mark, entries, size, start = struct.unpack("<4s28xQQQ", r.read(at64, 56))
            if mark != END64:
                raise ValueError("no ZIP64 end record where its locator points")
            shift = 0
    at = start + shift
    for _ in range(entries):
        mark, method, packed, n, n_name, n_extra, n_note, offset = struct.unpack("<4s6xH8xIIHHH8xI", r.read(at, 46))
        if mark != ENTRY:
            raise ValueError("broken central directory")
        name = r.read(at + 46, n_name).decode()
        extra = r.read(at + 46 + n_name, n_extra)
        while len(extra) >= 4:
            kind, length = struct.unpack_from("<HH", extra)
            if kind == 1:  # 64-bit values, only those that do not fit, in this order
                wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                n = next(wide) if n == FULL32 else n
                packed = next(wide) if packed == FULL32 else packed
                offset = next(wide) if offset == FULL32 else offset
            extra = extra[4 + length :]
        yield name, method, n, offset + shift
        at += 46 + n_name + n_extra + n_note


def stored_member(r: Ranges, offset: int) -> int:
    """Where the content of the stored member with this local header begins."""
    mark, n_name, n_extra = struct.unpack("<4s22xHH", r.read(offset, 30))
    if mark != LOCAL:
        raise ValueError("no local header where the directory points")
    return offset + 30 + n_name + n_extra


def read_records(r: Ranges) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """Every indexed record of an archive, each by its own range."""
    members = {name: (method, size, offset) for name, method, size, offset in directory(r)}
    for name in (DATA, INDEX):
        if name not in members:
            raise ValueError(f"no member {name}")
        if members[name][0] != 0:
            raise ValueError(f"{name} is compressed; it can't be read by range")
    index = r.read(stored_member(r, members[INDEX][2]), members[INDEX][1])
    begin = stored_member(r, members[DATA][2])
    for line in index.splitlines():
        entry = json.loads(line)
        yield parse_record(r.read(begin + entry["offset"], entry["length"]))


# --- Spark -----------------------------------------------------------------------------------


def dedup_plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, sha1, n, refers_to): refers_to is null for responses."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1(F.col("payload").cast("binary"))).withColumn("n", F.octet_length("payload").cast("long"))
    groups = rows.where(F.col("n") >= MIN_REVISIT).groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("copies"))
    groups = saved(groups.where("copies > 1").select("sha1", "first"), "copies")
    if groups.count() <= BROADCAST_GROUPS:
        out = rows.join(F.broadcast(groups), "sha1", "left")
    else:  # a payload that many pages share goes to SALTS places
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = rows.join(groups, ["sha1", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.select("page_id", "url", "payload", "sha1", "n", F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(plan: DataFrame, folder: str) -> DataFrame:
    """Writes rows of :func:`dedup_plan`; (path, bytes, records) of each archive, written down once."""
    ship(plan.sparkSession)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        data, index, at = [], [], 0

        def flush() -> pd.DataFrame:
            nonlocal data, index, at
            content = pack_archive(b"".join(data), b"".join(index))
            name = f"{uuid.uuid4().hex}.zip"
            with fs.open_output_stream(f"{base}/{name}") as f:
                f.write(content)
            row = pd.DataFrame({"path": [f"{folder}/{name}"], "bytes": [len(content)], "records": [len(index)]})
            data, index, at = [], [], 0
            return row

        for pdf in batches:
            for page_id, url, payload, sha1, n, refers_to in pdf.itertuples(index=False):
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                record = make_record(page_id, url, payload.encode(), refers_to, n, sha1)
                data.append(record)
                index.append(json.dumps({"id": page_id, "offset": at, "length": len(record)}).encode() + b"\n")
                at += len(record)
                if at >= ARCHIVE_BYTES:
                    yield flush()
        if index:
            yield flush()

    # ids cross to pandas as text, which keeps nulls and all 64 bits
    rows = plan.select(F.col("page_id").cast("string"), "url", "payload", "sha1", "n", F.col("refers_to").cast("string"))
    return saved(rows.mapInPandas(pack, "path string, bytes long, records long"), "archives")


def read_archives(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """One row for each record of the archives: what its headers and its payload say."""
    ship(spark)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            ids = ("page_id", "refers_to")  # kept from becoming floats where some are null
            return pd.DataFrame({c: pd.array(v, dtype="Int64") if c in ids else list(v) for c, v in zip(columns, zip(*rows))})

        for pdf in batches:
            for path in pdf["path"]:
                fs, name = file_system(path)
                with fs.open_input_file(name) as f:
                    rows, size = [], 0
                    for warc, http, payload in read_records(Ranges(f)):
                        kind = warc["warc-type"]
                        digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
                        if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(http["content-length"])):
                            raise ValueError(f"{warc['warc-record-id']}: the payload is not what its headers say")
                        ids = (page_of(warc["warc-record-id"]), page_of(warc.get("warc-refers-to")))
                        rows.append((ids[0], warc.get("warc-target-uri"), int(http["content-length"]), digest, kind, ids[1], payload if kind == "response" else None))
                        size += len(payload)
                        if size > (8 << 20):
                            yield frame(rows)
                            rows, size = [], 0
                    if rows:
                        yield frame(rows)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return archives.select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(unpack, schema)


def archive_round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Writes pages to archives in the shared folder and reads all their records back."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    archives = write_archives(dedup_plan(pages, **columns), folder)
    until_exit(spark, folder)
    return read_archives(spark, archives)
