"""WARC records in ZIP packages: writing, and reading them back by ranges.

A package is a ZIP of stored members: `archive/data.warc.gz`, a WARC file with one gzip member for each
record, and `indexes/index.cdxj`, a line for each record with its offset and length. Tasks write packages of
bounded size straight to the shared folder and return their paths; a retried task writes under a new name, and
only what a successful task returned is in the manifest. The reader parses the central directory (ZIP64 too),
finds where stored members start, and reads the index and then spans of records, never a whole package and
never a copy on disk.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_path, table, text_batches

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_BYTES, PACKAGE_RECORDS = 32 << 20, 20_000
SPAN_BYTES, READ_BYTES = 4 << 20, 256 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers: int | None, revisit: bool) -> bytes:
    """One WARC 1.1 record, gzipped. A revisit keeps the HTTP header, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'none' if page is None else page}>", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one gzipped record."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return headers, rest[: int(headers["content-length"])]


class Package:
    """Writes one ZIP to a stream that cannot seek."""

    def __init__(self, fs, path: str):
        import zipfile

        self.path, self.stream = path, fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index: list[str] = []
        self.at = 0

    def add(self, page, url, raw: bytes) -> None:
        self.data.write(raw)
        self.index.append(f"{'none' if page is None else page} {json.dumps({'url': url, 'offset': self.at, 'length': len(raw)})}\n")
        self.at += len(raw)

    def close(self) -> tuple[str, int, int]:
        import zipfile

        self.data.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
            f.write("".join(self.index).encode())
        self.zip.close()
        self.stream.close()
        return self.path, len(self.index), self.at


def central_directory(f, size: int) -> dict[str, tuple[int, int, int]]:
    """Member name -> (method, offset of the local header, size) of an open ZIP, by its last bytes, ZIP64 included."""

    def read(at: int, n: int) -> bytes:
        return f.read_at(n, at)

    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    if end < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<10xHII", tail, end)
    locator = end - 20
    if 0xFFFF == n or 0xFFFFFFFF in (length, start) or (locator >= 0 and tail[locator : locator + 4] == b"PK\6\7"):
        (at64,) = struct.unpack_from("<8xQ", tail, locator)
        n, length, start = struct.unpack_from("<32xQQQ", read(at64, 56))
    directory, members, at = read(start, length), {}, 0
    for _ in range(n):
        if directory[at : at + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        method, packed, plain, n_name, n_extra, n_comment, local = struct.unpack_from("<10xH8xIIHHH8xI", directory, at)
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra, k = directory[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            kind, width = struct.unpack_from("<HH", extra, k)
            if kind == 1:  # only the fields that are full in the plain entry, in this order
                wide = list(struct.unpack_from(f"<{width // 8}Q", extra, k + 4))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            k += 4 + width
        members[name] = (method, local, packed)
        at += 46 + n_name + n_extra + n_comment
    return members


def stored_start(f, member: tuple[int, int, int]) -> int:
    """Where a stored member's bytes begin."""
    method, local, _ = member
    if method:
        raise ValueError("the member is compressed; only stored ones can be read by range")
    n_name, n_extra = struct.unpack_from("<26xHH", f.read_at(30, local))
    return local + 30 + n_name + n_extra


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, _revisit, _refers): which rows become revisits, and of which page.

    Only ids and digests meet by payload; the html is then dealt by page. Of equal payloads the largest page_id is
    the response, whatever the order of rows; a page's html is one value of its row, however long.
    """
    sha = F.sha1(F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary"))
    small = pages.select("page_id", sha.alias("d"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("n")).where(F.col("n") >= least_bytes)
    groups = small.groupBy("d").agg(F.max("page_id").alias("_refers"), F.count("*").alias("c")).where("c > 1").select("d", "_refers")
    groups = cut(groups, "warc-groups")
    revisits = small.join(groups, "d").where(~F.col("page_id").eqNullSafe(F.col("_refers")))
    revisits = revisits.select(F.col("page_id").alias("_page"), F.col("d").alias("_d"), "_refers").distinct()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), sha.alias("_sha"))
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_sha") == F.col("_d"))
    rows = rows.join(revisits, same, "left")
    return rows.select("page_id", "url", "_refers", F.col("_d").isNotNull().alias("_revisit"), "html")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write every row of (page_id, url, html) to ZIP packages in `folder`; the manifest (path, records, bytes)."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs as pafs

        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        own, done = None, []
        for batch in text_batches(batches):
            for page, url, refers, revisit, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = own or Package(fs, f"{base}/{uuid.uuid4().hex}.wacz")
                own.add(page, url, record(page, url, (html or "").encode(), refers, revisit))
                if own.at >= PACKAGE_BYTES or len(own.index) >= PACKAGE_RECORDS:
                    done.append(own.close())
                    own = None
        if own:
            done.append(own.close())
        path, records, size = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(records, pa.int64()), pa.array(size, pa.int64())], ["path", "records", "bytes"])

    planned = plan_records(pages, least_bytes)
    return cut(planned.mapInArrow(run, "path string, records bigint, bytes bigint"), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload) of every record."""
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + (", payload binary" if payloads else "")

    def page(urn: str | None) -> int | None:
        name = (urn or "none>").rpartition(":")[2].rstrip(">")
        return None if name == "none" else int(name)

    def rows(fs, path: str):
        with fs.open_input_file(path) as f:
            members = central_directory(f, f.size())
            index_at, data_at = stored_start(f, members[INDEX]), stored_start(f, members[DATA])
            lines = f.read_at(members[INDEX][2], index_at).decode().splitlines()
            spans = [(x["offset"], x["length"]) for x in (json.loads(line.partition(" ")[2]) for line in lines)]
            i = 0
            while i < len(spans):  # neighbouring records are read together, up to SPAN_BYTES
                j, start = i + 1, spans[i][0]
                while j < len(spans) and spans[j][0] + spans[j][1] - start <= SPAN_BYTES:
                    j += 1
                span = f.read_at(spans[j - 1][0] + spans[j - 1][1] - start, data_at + start)
                for offset, length in spans[i:j]:
                    yield parse_record(span[offset - start : offset - start + length])
                i = j

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs as pafs

        fs, _ = pafs.FileSystem.from_uri(folder)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads
        names = [x.split()[0] for x in schema.split(", ")]
        out: list[tuple] = []

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                for head, block in rows(fs, path):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    told = head["warc-payload-digest"].removeprefix("sha1:")
                    size = int(http.decode().lower().rpartition("content-length:")[2])
                    if head["warc-type"] == "response" and (len(payload) != size or digest(payload) != told):
                        raise ValueError(f"{path}: the payload of {head['warc-record-id']} isn't what its header says")
                    refers = page(head["warc-refers-to"]) if "warc-refers-to" in head else None
                    out.append((page(head["warc-record-id"]), head.get("warc-target-uri"), size, told, head["warc-type"], refers) + ((payload,) if payloads else ()))
                    if len(out) >= 2000:
                        yield batch_of(out)
                        out = []
        if out:
            yield batch_of(out)

    n, size = manifest.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    # one package a task while there are few, and READ_BYTES a task when there are many
    tasks = max(1, min(n, 4 * manifest.sparkSession.sparkContext.defaultParallelism), -(-size // READ_BYTES))
    return manifest.select("path").repartition(tasks).mapInArrow(run, schema)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all of `pages`, read the packages back.

    Of rows with equal payloads the one with the largest page_id is the response and the others revisit it;
    repeated rows with that id are all responses. Null html is an empty payload, a null url has no header, a
    null page_id counts as smaller than any. An empty table has no package and no record.
    """
    folder = shared_path(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op2_warc": op2_warc}

ORACLE = {
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) || '0' AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((CAST('0x' || substr(x, CAST(i * 5 // 4 + 1 AS BIGINT), 2) AS BIGINT) >> CAST(3 - (i * 5) % 4 AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM s
"""
}
