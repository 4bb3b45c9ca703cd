"""Shared helpers of the operators in this subpackage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, wherever an operator counts or shingles words: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or a temporary one where that is unset (tests).

    On a cluster the setting must be there: each executor would write to its own disk, and tables would be lost.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='civicledger-')}"
        atexit.register(shutil.rmtree, base.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Narrow rows of a written file at least, where their number is bounded beforehand.
FILE_ROWS = 500_000


def cut(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there and no executor's loss undoes it.

    With `rows`, a number of narrow rows that isn't exceeded, small tables become few files.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def drop(*frames: DataFrame | None) -> None:
    """Delete the tables that cut() wrote for `frames`, which nothing that is still to run may read."""
    for df in frames:
        if df is not None and (path := getattr(df, "_table", None)):
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark deletes a job's shuffle files when the job ends, and not once the driver's JVM collects garbage.

    For chains of steps that each write a table: no DataFrame with a shuffle of its own may be run twice inside.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Bytes of an Arrow batch on its way to a Python worker, whatever its rows are like.
BATCH_BYTES = 8 << 20
#: Rows that are broadcast at most; a larger side is shuffled instead.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """`df` (narrow rows of a written table), marked for broadcast if a count shows that it's small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; the session's Arrow batches are bounded, as its texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of `text`; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key's decimal text, modulo n: the fold rule of the labelled tables."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def text_batches(batches, budget: int = 2 << 20) -> Iterator[tuple]:
    """Arrow batches with columns (.., text last) as slices of at most `budget` text bytes each (or one row).

    Bounds the memory of vectorised kernels whatever the size of Spark's batches.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0)).astype(np.int64)
        ends, start = np.cumsum(size), 0
        while start < n:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + budget, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()  # the worker lives on for other tasks


def text_buffer(column):
    """(bytes, offsets) of an Arrow string column as numpy arrays; nulls are empty."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    filled = pc.fill_null(column, "").cast(pa.large_string())
    filled = pa.concat_arrays([filled])
    _, offsets, data = filled.buffers()
    off = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


_CACHES: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What a Python worker keeps from task to task for one operator; those of other operators are let go."""
    for other in [x for x in _CACHES if x != owner]:
        del _CACHES[other]
    return _CACHES.setdefault(owner, {})


FACTOR = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64


def power_table(n: int):
    """FACTOR^i and FACTOR^-i modulo 2^64 for i < n, kept by each worker."""
    import numpy as np

    kept = worker_cache("powers")
    if len(kept.get("up", ())) < n:
        for name, base in (("up", FACTOR), ("down", pow(FACTOR, -1, 1 << 64))):
            out = np.ones(1, np.uint64)
            while len(out) < max(n, 1 << 20):
                out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
            kept[name] = out
    return kept["up"], kept["down"]
