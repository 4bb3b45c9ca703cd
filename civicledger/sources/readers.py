"""Reading what public portals publish: dumps, JSON of several shapes, XML, GeoJSON, and paged APIs."""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def read_csv(spark: SparkSession, path: str, schema: str | None = None, multiline: bool = False) -> DataFrame:
    """A headed CSV; rows that don't fit the schema are kept in _bad rather than failing the load."""
    r = spark.read.option("header", True).option("mode", "PERMISSIVE").option("multiLine", multiline).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("escape", '"')
    if schema:
        df = r.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").csv(path)
    else:
        df = r.csv(path)
    return df.toDF(*[" ".join(c.replace("﻿", "").split()) for c in df.columns])


def bad_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a CSV read with a schema: the rows that fit it, and one row with the number of those that don't."""
    if "_bad" not in df.columns:
        return df, df.sparkSession.createDataFrame([(0,)], "bad_rows long")
    return df.where("_bad IS NULL").drop("_bad"), df.agg(F.count("_bad").alias("bad_rows"))


def read_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines, an array, or an object whose records are under result.records, records, features or the first array.

    With a `schema` (of the whole value) the data isn't read to find one.
    """
    r = spark.read.option("multiLine", _is_document(spark, path))
    df = (r.schema(schema) if schema else r).json(path)
    for names in (("result", "records"), ("records",), ("features",)):
        c, at = F.col(names[0]), df.schema
        if names[0] not in df.columns:
            continue
        if len(names) == 2:
            inner = at[names[0]].dataType
            if not hasattr(inner, "names") or names[1] not in inner.names:
                continue
            c = c[names[1]]
        return df.select(F.inline(c))
    arrays = [f.name for f in df.schema if f.dataType.typeName() == "array" and f.dataType.elementType.typeName() == "struct"]
    return df.select(F.inline(arrays[0])) if arrays and len(df.columns) <= 3 else df


#: Bytes of a file that are looked at to tell lines from a document.
HEAD = 1 << 16


def _is_document(spark: SparkSession, path: str) -> bool:
    """Whether the first line isn't a whole JSON value by itself; one that is longer than the file's head is taken for one."""
    from .bounded import read_head

    head, size = read_head(spark, path, HEAD)
    first, end, _ = head.removeprefix("﻿".encode()).partition(b"\n")
    if not end and size > len(head):
        return False
    try:
        return bool(first.strip()) and not isinstance(json.loads(first), dict)
    except ValueError:
        return True


def read_xml(spark: SparkSession, path: str, row_tag: str = "record", schema: str | None = None) -> DataFrame:
    r = spark.read.format("xml").option("rowTag", row_tag)
    return (r.schema(schema) if schema else r).load(path)


def detect_format(name: str, content_type: str = "", declared: str = "", head: str = "") -> str:
    """csv, json, jsonl, geojson or xml by declaration, media type, name or first characters; else unknown."""
    for text in (declared.lower(), content_type.lower(), Path(name).suffix.lower()):
        for kind in ("geojson", "jsonl", "ndjson", "json", "csv", "xml"):
            if kind in text:
                return {"ndjson": "jsonl"}.get(kind, kind)
    lead = head.lstrip("﻿ \n\r\t")[:1]
    if lead in "{[" and lead:
        return "json"
    if lead == "<":
        return "xml"
    lines = [x for x in head.splitlines() if x.strip()]
    return "csv" if len(lines) >= 2 and all("," in x for x in lines) else "unknown"


def retry(call: Callable[[], object], tries: int = 6, first: float = 2.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep, linear: bool = False):
    """Call until it works, waiting twice as long each time, or `first` seconds longer."""
    for n in range(tries):
        try:
            return call()
        except OSError:
            if n == tries - 1:
                raise
            sleep(min(most, first * (n + 1) if linear else first * 2**n))
    return None


class PagedSource(DataSource):
    """A paged API as a table: `spark.read.format("paged").option("url", ..)`, a partition for each page.

    Options: url (a folder of offset-named JSON pages, or an http address that takes limit and offset), schema,
    total (what the first page's answer states, if not given), page (records a page), start (offset to go on from),
    wait (linear: 2, 4, 6 .. seconds between tries), tries, on_error (skip: pages that keep failing are left out, and
    said so on the task's log; rows: they are a row each, with their first record's number, their records and the error in the columns page, records
    and error, which the others have as null; else the load fails), parts (first:records, separated by commas: only these).

    As a stream its offset is the number of records read. A batch holds all that the API has had since the last one,
    a page or part of one to a task, and is read again between the same offsets after a restart.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.options.get("schema", "id string, record string") + (", page bigint, records bigint, error string" if self.options.get("on_error") == "rows" else "")

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options), [f.name for f in schema.fields])

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return PagedStreamReader(dict(self.options), [f.name for f in schema.fields])


#: Columns of failed pages.
EXTRA = ("page", "records", "error")


class Page(InputPartition):
    """`take` records of the page that begins at record `offset`, of which the first `skip` are left out."""

    def __init__(self, offset: int, skip: int = 0, take: int | None = None):
        self.offset, self.skip, self.take = offset, skip, take


def page_rows(options: dict, names: list[str], part: Page) -> Iterator[tuple]:
    url, size = options["url"], int(options.get("page", 32000))
    try:
        rows = retry(lambda: fetch_page(url, part.offset, size), int(options.get("tries", 6)), float(options.get("first", 2.0)), linear=options.get("wait") == "linear")
    except OSError as e:
        if options.get("on_error") == "rows":
            yield tuple({"page": part.offset + part.skip, "records": size if part.take is None else part.take, "error": str(e)[:300]}.get(n) for n in names)
        elif options.get("on_error") == "skip":
            print(f"page {part.offset} of {url} left out: {e}", file=sys.stderr)
        else:
            raise
        return
    for r in rows[part.skip : None if part.take is None else part.skip + part.take]:
        whole = json.dumps(r, sort_keys=True, ensure_ascii=False)
        yield tuple(whole if n == "record" else None if r.get(n) in (None, "", "None") or options.get("on_error") == "rows" and n in EXTRA else str(r[n]) for n in names)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.options, self.names = options, names

    def partitions(self) -> list[InputPartition]:
        size, start = int(self.options.get("page", 32000)), int(self.options.get("start", 0))
        if "parts" in self.options:
            parts = [tuple(map(int, x.split(":"))) for x in self.options["parts"].split(",") if x]
            return [Page(first - first % size, first % size, n) for first, n in parts]
        total = int(self.options["total"]) if "total" in self.options else retry(lambda: stated_total(self.options["url"], start, size))
        return [Page(o) for o in range(start, total, size)] or [Page(start)]

    def read(self, partition) -> Iterator[tuple]:
        return page_rows(self.options, self.names, partition)


class PagedStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict, names: list[str]):
        self.options, self.names = options, names

    def initialOffset(self) -> dict:  # noqa: N802
        return {"row": int(self.options.get("start", 0))}

    def latestOffset(self) -> dict:  # noqa: N802
        size = int(self.options.get("page", 32000))
        return {"row": int(self.options["total"]) if "total" in self.options else retry(lambda: stated_total(self.options["url"], 0, size))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        size, first, last = int(self.options.get("page", 32000)), start["row"], end["row"]
        pages = range(first - first % size, last, size)
        return [Page(o, max(0, first - o), min(last, o + size) - max(first, o)) for o in pages]

    def read(self, partition) -> Iterator[tuple]:
        return page_rows(self.options, self.names, partition)


def fetch_answer(url: str, offset: int, limit: int) -> dict:
    if url.startswith(("http://", "https://")):
        from urllib.request import urlopen

        with urlopen(f"{url}{'&' if '?' in url else '?'}limit={limit}&offset={offset}", timeout=60) as f:  # noqa: S310
            body = json.load(f)
    else:
        body = json.loads(Path(url, f"{offset}.json").read_text())
    return body["result"] if "result" in body else body


def fetch_page(url: str, offset: int, limit: int) -> list[dict]:
    return fetch_answer(url, offset, limit)["records"]


def stated_total(url: str, offset: int, limit: int) -> int:
    """The number of records of the whole resource, which a page's answer states; without it, pages would be missed."""
    total = fetch_answer(url, offset, limit).get("total")
    if total is None:
        raise ValueError(f"{url} states no total; give the option total")
    return int(total)
