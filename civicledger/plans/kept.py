"""Views and tables that are kept between queries: summaries by input file, streams put in once, GeoJSON as rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import ingest
from ..sources.refresh import KeptView, file_system
from ..sources.sinks import shared_folder
from . import maps
from .registry import view


def store(spark: SparkSession, name: str, sf_dir: str) -> str:
    """Where this session keeps `name` of the tables in a folder."""
    return f"{shared_folder(spark)}/kept-{name}-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"


@view("kept_order_summary", "status:s year:l n:l total:d least:d last:s mean:d", "", """
  SELECT o_orderstatus AS status, year(o_orderdate) AS year, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS total, min(o_totalprice) AS least, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last, avg(o_totalprice) AS mean
  FROM orders WHERE o_totalprice > 1000 GROUP BY ALL""")  # fmt: skip
def kept_order_summary(t):
    """Orders by status and year, refreshed from the files that are new or changed since this session last asked."""
    measures = {"n": ("count", "1"), "total": ("sum", "CAST(o_totalprice AS DECIMAL(18, 2))"), "least": ("min", "o_totalprice"), "last": ("max", "to_date(o_orderdate)"), "mean": ("avg", "o_totalprice")}
    kept = KeptView(t.spark, f"{t.sf_dir}/orders.parquet", store(t.spark, "orders", t.sf_dir), {"status": "o_orderstatus", "year": "year(o_orderdate)"}, measures, "o_totalprice > 1000")
    kept.refresh()
    return kept.read()


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A folder of Parquet files, or a single one, as a stream of files."""
    schema = spark.read.parquet(path).schema
    where, fs = file_system(spark, path)
    if fs.getFileStatus(where).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())


@view("ingested_events", "event_type:s n:l users:l total:d first_id:l last_id:l", "", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, sum(CAST(value AS DECIMAL(18, 4))) AS total, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1")
def ingested_events(t):
    """Events put into a table as a stream, each batch once by its number, and summed up from there."""
    at = store(t.spark, "events", t.sf_dir)
    ingest.put_stream(stream_of(t.spark, f"{t.sf_dir}/events.parquet"), f"{at}/table", f"{at}/checkpoint")
    rows = t.spark.read.schema(t.raw("events").schema).parquet(f"{at}/table")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@view("geojson_features", "geometry_type:s n:l named:l xmin:d ymin:d xmax:d ymax:d value:d", "", """
  WITH c AS (SELECT c_custkey % 360 - 180 AS x, c_nationkey - 12 AS y, c_nationkey % 3 AS kind, c_name, c_acctbal FROM customer)
  SELECT CASE kind WHEN 0 THEN 'Point' WHEN 1 THEN 'Polygon' ELSE 'MultiLineString' END AS geometry_type, count(*) AS n, count(c_name) AS named, min(x) AS xmin, min(y) AS ymin, max(CASE kind WHEN 0 THEN x WHEN 1 THEN x + 2 ELSE x + 1 END) AS xmax,
         max(CASE kind WHEN 0 THEN y WHEN 1 THEN y + 1 ELSE y + 3 END) AS ymax, sum(CAST(c_acctbal AS DECIMAL(18, 2))) AS value FROM c GROUP BY kind""")  # fmt: skip
def geojson_features(t):
    """Customers as GeoJSON features of three types, and these as rows again: counts, boxes and a property's sum by type."""
    x, y, kind = F.col("c_custkey") % 360 - 180, F.col("c_nationkey") - 12, F.col("c_nationkey") % 3
    at = lambda dx, dy: F.format_string("[%d, %d]", (x + dx).cast("long"), (y + dy).cast("long"))
    ring = F.concat(F.lit("[["), F.concat_ws(", ", at(0, 0), at(2, 0), at(2, 1), at(0, 0)), F.lit("]]"))
    lines = F.concat(F.lit("[["), F.concat_ws(", ", at(0, 0), at(1, 3)), F.lit("], ["), at(1, 1), F.lit("]]"))
    shape = F.when(kind == 0, F.concat(F.lit('"Point", "coordinates": '), at(0, 0))).when(kind == 1, F.concat(F.lit('"Polygon", "coordinates": '), ring)).otherwise(F.concat(F.lit('"MultiLineString", "coordinates": '), lines))
    properties = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("value")))
    text = F.concat(F.lit('{"type": "Feature", "properties": '), properties, F.lit(', "geometry": {"type": '), shape, F.lit("}}"))
    rows = maps.features(t.raw("customer").select(text.alias("value")))
    of = lambda name, to: F.try_variant_get(F.col("properties")[name], "$", to)
    boxes = [f(c).alias(c) for f, c in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax"))]
    return rows.groupBy("geometry_type").agg(F.count("*").alias("n"), F.count(of("name", "string")).alias("named"), *boxes, F.sum(of("value", "double").cast("decimal(18,2)")).alias("value"))
