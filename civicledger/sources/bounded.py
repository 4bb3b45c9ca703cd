"""Reading at most so many bytes of a resource: byte ranges as partitions, whole records, and what was left out.

`spark.read.format("bounded")` splits the first `max_bytes` of a file or http resource into ranges. As in any split of a
text, a range's records are those that begin in it; the last one may end behind it, but no byte after the budget is
read. A record that the budget cuts is left out, and each row tells whether anything was. Records are lines.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .refresh import file_system

MAX_BYTES, PART_BYTES = 5_000_000, 1 << 20
STEP = 1 << 16  # bytes read at a time behind a range's end
# Media types and file endings of structured text.
TEXT_TYPES = ["text/", "json", "xml", "csv", "javascript", "yaml"]
TEXT_ENDINGS = ["csv", "tsv", "json", "jsonl", "ndjson", "geojson", "xml", "txt", "yaml", "yml", "html", "htm"]


def is_structured_text(format_: str | None = None, media_type: str | None = None, name: str = "") -> bool:
    """Whether a resource can be read as text, by its declared format, its media type or its name's ending."""
    ending = name.split("?")[0].split("#")[0].rstrip("/").rpartition("/")[2].rpartition(".")[2].lower()
    kind = (media_type or "").split(";")[0].strip().lower()
    return (format_ or "").strip().lower() in TEXT_ENDINGS or any(x in kind for x in TEXT_TYPES) or (not kind and ending in TEXT_ENDINGS)


def size_of(path: str) -> int:
    """The resource's length in bytes."""
    if path.startswith(("http://", "https://")):
        from urllib.request import Request, urlopen

        with urlopen(Request(path, method="HEAD"), timeout=60) as f:  # noqa: S310
            return int(f.headers["Content-Length"])
    from pyarrow.fs import FileSystem

    fs, at = FileSystem.from_uri(path)
    return fs.get_file_info(at).size


def read_range(path: str, start: int, end: int) -> bytes:
    """Bytes start .. end - 1."""
    if path.startswith(("http://", "https://")):
        from urllib.request import Request, urlopen

        with urlopen(Request(path, headers={"Range": f"bytes={start}-{end - 1}"}), timeout=60) as f:  # noqa: S310
            body = f.read(end if f.status != 206 else end - start)  # a server that knows no ranges sends all from the start
            return body if f.status == 206 else body[start:]
    from pyarrow.fs import FileSystem

    fs, at = FileSystem.from_uri(path)
    with fs.open_input_file(at) as f:
        return f.read_at(end - start, start)


class ByteRange(InputPartition):
    def __init__(self, start: int, end: int, limit: int, size: int):
        self.start, self.end, self.limit, self.size = start, end, limit, size


class BoundedSource(DataSource):
    """Options: path (file or http address; a path without a scheme is local), max_bytes, part_bytes, size (if it is known)."""

    @classmethod
    def name(cls) -> str:
        return "bounded"

    def schema(self) -> str:
        return "offset bigint, value string, truncated boolean"

    def reader(self, schema) -> DataSourceReader:
        return BoundedReader(dict(self.options))


class BoundedReader(DataSourceReader):
    def __init__(self, options: dict):
        path = options["path"]
        self.path = path if "://" in path or path.startswith("file:") else f"file://{path}"
        self.most, self.part = int(options.get("max_bytes", MAX_BYTES)), int(options.get("part_bytes", PART_BYTES))
        self.size = int(options["size"]) if "size" in options else None

    def partitions(self) -> list[InputPartition]:
        size = size_of(self.path) if self.size is None else self.size
        limit = min(size, self.most)
        return [ByteRange(s, min(s + self.part, limit), limit, size) for s in range(0, limit, self.part)] or [ByteRange(0, 0, 0, size)]

    def read(self, partition) -> Iterator[tuple]:
        start, end, limit, size = partition.start, partition.end, partition.limit, partition.size
        # the byte before tells whether a record begins at the range's own first byte
        data, first = read_range(self.path, max(0, start - 1), end) if end > start else b"", max(0, start - 1)
        begins = 0
        if start:
            at = data.find(b"\n")
            if at < 0:
                return  # all of it belongs to a record that began before
            begins = at + 1
        reached = end
        while reached < limit and not data.endswith(b"\n"):
            more = read_range(self.path, reached, min(limit, reached + STEP))
            reached += len(more)
            cut = more.find(b"\n")
            data += more if cut < 0 else more[: cut + 1]
            if not more:
                break
        offset = first + begins
        lines = data[begins:].split(b"\n")
        ended = lines.pop()
        for line in lines:
            yield offset, line.removesuffix(b"\r").decode("utf-8", "replace").removeprefix("﻿" if offset == 0 else ""), limit < size
            offset += len(line) + 1
        if ended and limit == size:  # the resource's last record has no line end; a cut one is left out
            yield offset, ended.removesuffix(b"\r").decode("utf-8", "replace").removeprefix("﻿" if offset == 0 else ""), False


def read_lines(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """(offset, value, truncated) of the whole lines among the first `max_bytes`."""
    spark.dataSource.register(BoundedSource)
    return spark.read.format("bounded").options(path=path, max_bytes=max_bytes, part_bytes=part_bytes).load()


def read_csv(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, part_bytes: int = PART_BYTES, sep: str = ",") -> DataFrame:
    """A headed CSV's whole records within the budget, as strings; `_truncated` says whether there are more."""
    import csv

    lines = read_lines(spark, path, max_bytes, part_bytes)
    size = size_of(path if "://" in path else f"file://{path}")
    head = read_range(path if "://" in path else f"file://{path}", 0, min(size, max_bytes, STEP)).decode("utf-8", "replace").lstrip("﻿")
    names = next(csv.reader([head.split("\n")[0].rstrip("\r")], delimiter=sep), [])
    schema = ", ".join(f"`{n.strip() or f'column_{i}'}` string" for i, n in enumerate(names, 1))
    if not schema:
        raise ValueError("the resource has no header within its first bytes")
    rows = lines.where("offset > 0 AND trim(value) <> ''")
    return rows.select(F.from_csv("value", schema, {"sep": sep, "mode": "PERMISSIVE"}).alias("r"), "truncated").select("r.*", F.col("truncated").alias("_truncated"))


def read_document(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> str:
    """A JSON or GeoJSON document that fits the budget; one that doesn't is an error, as half of it says nothing.

    What passes through the driver is the budget at most.
    """
    data, size = read_head(spark, path, max_bytes)
    if size > len(data):
        raise ValueError(f"{path} has {size} bytes, more than {max_bytes}; raise max_bytes or choose a smaller resource")
    text = data.decode("utf-8", "replace").removeprefix("﻿")
    json.loads(text)
    return text


def read_head(spark: SparkSession, path: str, n: int) -> tuple[bytes, int]:
    """The first n bytes of a file (of a folder's first file), in any store that Spark reads, and its length."""
    where, fs = file_system(spark, path)
    if fs.getFileStatus(where).isDirectory():
        inside = sorted((s.getPath().toString() for s in fs.listStatus(where) if s.isFile() and not s.getPath().getName().startswith(("_", "."))))
        if not inside:
            return b"", 0
        where, fs = file_system(spark, inside[0])
    stream = fs.open(where)
    try:
        return bytes(stream.readNBytes(n)), fs.getFileStatus(where).getLen()
    finally:
        stream.close()
