"""Ingestion that goes on where it stopped: a paged API as a stream, written once for each batch number.

The stream's checkpoint holds how far each batch goes before the batch is read, so a batch that a crash cut short is read
again between the same offsets and overwrites the folder of its number: no row is lost, and none is there twice. A
page that keeps failing doesn't stop the load; it is a row among the batch's failed ones, and repair() fetches it again.

Layout: `table`/batch=<number>/failed=<true or false>/; a repaired batch has the number -1 - <number>.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import EXTRA, PagedSource
from .refresh import children


def _options(url: str, schema: str, options: dict) -> dict:
    return {"url": url, "schema": schema, "on_error": "rows", **{k: str(v) for k, v in options.items()}}


def _write(rows: DataFrame, table: str, number: int) -> None:
    out = rows.withColumn("failed", F.col("error").isNotNull())
    out.write.mode("overwrite").partitionBy("failed").parquet(f"{table}/batch={number}")


def ingest(spark: SparkSession, url: str, table: str, checkpoint: str, schema: str, **options) -> int:
    """Load all that the API at `url` has and `table` hasn't; how many batches `table` then has.

    `schema` lists the record's fields, as strings (and `record`, the whole of it); `options` are those of the paged source.
    """
    spark.dataSource.register(PagedSource)
    stream = spark.readStream.format("paged").options(**_options(url, schema, options)).load()
    _run(stream, lambda rows, number: _write(rows, table, number), checkpoint)
    return len(_numbers(spark, table))


def _run(stream: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()  # a batch that was cut short, and then what has come since
    finally:
        query.stop()


def put_stream(stream: DataFrame, table: str, checkpoint: str) -> None:
    """Put what a stream has had since the last time into `table`, each batch as the folder of its number: once, also
    if the batch had been written when the last run died."""
    _run(stream, lambda rows, number: rows.write.mode("overwrite").parquet(f"{table}/batch={number}"), checkpoint)


def _numbers(spark: SparkSession, table: str) -> list[int]:
    return sorted(n for n in (int(x[6:]) for x in children(spark, table) if x.startswith("batch=")) if n >= 0)


def _stored(spark: SparkSession, table: str, schema: str) -> DataFrame:
    kinds = f"{schema}, page bigint, records bigint, error string, failed boolean, batch int"
    return spark.read.schema(kinds).option("basePath", table).parquet(table) if children(spark, table) else spark.createDataFrame([], kinds)


def loaded(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """The records, with the number of their batch."""
    return _stored(spark, table, schema).where("NOT failed").drop(*EXTRA, "failed")


def failures(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """(batch, page, records, error) of pages that aren't loaded: of a repaired batch, what the repair couldn't fetch either."""
    rows = _stored(spark, table, schema).where("failed").select("batch", *EXTRA)
    repaired = {-1 - int(x[6:]) for x in children(spark, table) if x.startswith("batch=-")}
    now = rows.where(~F.col("batch").isin(sorted(repaired)) if repaired else F.lit(True))
    return now.withColumn("batch", F.when(F.col("batch") < 0, -1 - F.col("batch")).otherwise(F.col("batch")))


def repair(spark: SparkSession, url: str, table: str, schema: str, **options) -> int:
    """Fetch the failed pages of each batch again, in place of an earlier repair of it; how many pages still fail."""
    spark.dataSource.register(PagedSource)
    pages = _stored(spark, table, schema).where("failed AND batch >= 0").groupBy("batch").agg(F.collect_set(F.concat_ws(":", "page", "records")).alias("parts")).collect()  # failed pages only
    for r in pages:
        rows = spark.read.format("paged").options(**_options(url, schema, options), parts=",".join(sorted(r["parts"]))).load()
        _write(rows, table, -1 - r["batch"])
    return failures(spark, table, schema).count()
