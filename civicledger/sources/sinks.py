"""Writing: refreshed views, appended batches, merged tables; Parquet folders replaced as a whole."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import anti_insert, upsert
from .refresh import children, delete, input_files


def shared_folder(spark: SparkSession) -> str:
    """Where tables of this session go that all executors read: the checkpoint folder, and a temporary one only where
    everything runs on one machine. Elsewhere the setting must be there; a default could be each executor's own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='civicledger-')}"
        atexit.register(shutil.rmtree, base.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: what uses it several times has it made once."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(spark: SparkSession, df: DataFrame, path: str, force: bool = False) -> DataFrame:
    """Write a view once and read it back; an existing one is kept unless `force`."""
    df.write.mode("overwrite" if force else "ignore").parquet(path)
    return spark.read.parquet(path)


def append_new(spark: SparkSession, incoming: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append the rows of `incoming` whose keys the table at `path` lacks."""
    anti_insert(spark.read.parquet(path), incoming, keys).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def merge(spark: SparkSession, incoming: DataFrame, path: str, to: str, keys: list[str]) -> DataFrame:
    """The table at `path` with `incoming` put in, written to `to` (a table is never overwritten while it is read)."""
    upsert(spark.read.parquet(path), incoming, keys).write.mode("overwrite").parquet(to)
    return spark.read.parquet(to)


def update_by_ranges(spark: SparkSession, path: str, staged: DataFrame, to: str, key: str, step: int) -> DataFrame:
    """The table at `path` with the columns of `staged` (unique by `key`, a whole number) put into its rows, written to `to`
    one range of `step` keys after the other; a range that is there already isn't done again, so a stopped update goes on."""
    table = spark.read.parquet(path)
    ends = table.agg(F.min(key).alias("a"), F.max(key).alias("b")).first()
    columns = [c for c in staged.columns if c != key]
    new = staged.select(F.col(key).alias("_k"), F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in columns])
    starts = range(ends["a"] - ends["a"] % step, ends["b"] + 1, step) if ends["a"] is not None else ()
    for start in [*starts, None]:
        name = "none" if start is None else start
        if "_SUCCESS" in children(spark, f"{to}/range={name}"):
            continue
        # keys are compared on both sides, so that either scan reads its range only
        within = lambda c: F.col(c).isNull() if start is None else (F.col(c) >= start) & (F.col(c) < start + step)  # noqa: B023, E731
        rows = table.where(within(key)).join(new.where(within("_k")), F.col(key) == F.col("_k"), "left")
        rows = rows.withColumns({c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).select(*table.columns)
        rows.write.mode("overwrite").parquet(f"{to}/range={name}")
    return spark.read.parquet(to).drop("range")


class Answers:
    """Answers kept by query and input files: one is given again while it is younger than `seconds` and no file of its
    inputs has changed; else the query runs and its answer is stored."""

    def __init__(self, spark: SparkSession, folder: str, seconds: float = 300.0, now: Callable[[], float] = time.time):
        self.spark, self.folder, self.seconds, self.now = spark, folder, seconds, now

    def get(self, df: DataFrame) -> DataFrame:
        plan = df._jdf.queryExecution().optimizedPlan().canonicalized().toString()
        files = input_files(self.spark, *df.inputFiles())
        key = hashlib.sha256(repr((plan, files, df.schema.json())).encode()).hexdigest()[:32]
        times = sorted(int(x[3:]) for x in children(self.spark, f"{self.folder}/{key}") if x.startswith("at="))
        fresh = [x for x in times if x > (self.now() - self.seconds) * 1000 and "_SUCCESS" in children(self.spark, f"{self.folder}/{key}/at={x}")]
        at = fresh[-1] if fresh else int(self.now() * 1000)
        path = f"{self.folder}/{key}/at={at}"
        if not fresh:
            df.write.mode("overwrite").parquet(path)
            for old in times:
                delete(self.spark, f"{self.folder}/{key}/at={old}")
        return self.spark.read.schema(df.schema).parquet(path)
