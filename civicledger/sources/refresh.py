"""Views that are kept up to date: partial aggregates by input file, of which only new and changed files are computed.

A store is a folder of two tables. `partials` holds, for each run of refresh(), the partial aggregates of the files that
the run computed; `manifest` has one generation a run, which names for each live file the run that holds it. A
generation counts once it is written whole, so a refresh that dies leaves the former one in force and is simply done
again. Reading merges the partials of the latest generation's files; a file that changed or went away takes its
partials with it, also where an aggregate (min, max) can't be undone by subtraction.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and file system for `path`: any store that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    where, fs = file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    where, fs = file_system(spark, path)
    fs.delete(where, True)


def input_files(spark: SparkSession, *paths: str) -> list[tuple[str, int, int]]:
    """(file, size, time of change) of all data files under `paths`, from the store's listing; no job runs."""
    out = []
    for path in paths:
        where, fs = file_system(spark, path)
        found = fs.listFiles(where, True)
        while found.hasNext():
            s = found.next()
            name = s.getPath().getName()
            if not name.startswith(("_", ".")):
                out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sorted(out)


#: How each kind of measure is held by file, and how the parts make the whole.
PARTS: dict[str, dict[str, Callable[[Column], Column]]] = {
    "count": {"n": F.count}, "sum": {"s": F.sum}, "min": {"a": F.min}, "max": {"b": F.max}, "avg": {"s": F.sum, "n": F.count},
}
MERGE = {"n": F.sum, "s": F.sum, "a": F.min, "b": F.max}
WHOLE: dict[str, Callable[[Callable[[str], Column]], Column]] = {
    "count": lambda of: F.coalesce(of("n"), F.lit(0)), "sum": lambda of: of("s"), "min": lambda of: of("a"), "max": lambda of: of("b"), "avg": lambda of: of("s") / F.nullif(of("n"), F.lit(0)),
}


class KeptView:
    """SELECT keys, measures FROM a folder of Parquet files GROUP BY keys, kept in a store.

    measures: name -> (kind of PARTS, expression over the source's columns). keys: name -> expression. `where` filters
    rows. Keys may be null. The source's files are taken to be written once each: a file of the same name, size and
    time of change is the same file.
    """

    def __init__(self, spark: SparkSession, source: str, store: str, keys: dict[str, str], measures: dict[str, tuple[str, str]], where: str = "true"):
        self.spark, self.source, self.store, self.keys, self.measures, self.where = spark, source, store, keys, measures, where

    def _listing(self) -> DataFrame:
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.source)
        return files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("changed"))

    def _generations(self) -> list[int]:
        """Those that were written whole, in order."""
        found = [int(x[4:]) for x in children(self.spark, f"{self.store}/manifest") if x.startswith("gen=")]
        return sorted(g for g in found if "_SUCCESS" in children(self.spark, f"{self.store}/manifest/gen={g}"))

    def _manifest(self) -> DataFrame:
        done = self._generations()
        schema = "file string, size bigint, changed timestamp, run string"
        return self.spark.read.schema(schema).parquet(f"{self.store}/manifest/gen={done[-1]}") if done else self.spark.createDataFrame([], schema)

    def _parts(self, rows: DataFrame) -> DataFrame:
        """Partial aggregates of source rows by file and keys."""
        by = [F.col("_metadata.file_path").alias("file"), *[F.expr(e).alias(k) for k, e in self.keys.items()]]
        taken = rows.where(self.where).select(*by, *[F.expr(e).alias(f"_{m}") for m, (_, e) in self.measures.items()])
        aggs = [f(F.col(f"_{m}")).alias(f"{m}__{p}") for m, (kind, _) in self.measures.items() for p, f in PARTS[kind].items()]
        return taken.groupBy("file", *self.keys).agg(*aggs)

    def refresh(self) -> dict[str, int]:
        """Compute what is new or changed, let go what is gone, and say how many files that was.

        The names of new files pass through the driver, as a scan's own listing does.
        """
        before, now = self._manifest(), self._listing()
        joined = now.join(before.withColumnsRenamed({"size": "_size", "changed": "_changed"}), "file", "left")
        same = F.col("run").isNotNull() & (F.col("size") == F.col("_size")) & (F.col("changed") == F.col("_changed"))
        rows = joined.select("file", "size", "changed", F.when(same, F.col("run")).alias("run"), F.col("run").isNotNull().alias("known")).collect()
        fresh, held = [r for r in rows if r["run"] is None], before.count()
        report = {"new": sum(not r["known"] for r in fresh), "changed": sum(r["known"] for r in fresh), "gone": held - sum(r["known"] for r in rows), "kept": len(rows) - len(fresh)}
        if not fresh and not report["gone"] and self._generations():
            return report
        run = uuid.uuid4().hex[:12]
        if fresh:
            self._parts(self.spark.read.parquet(*[r["file"] for r in fresh])).write.parquet(f"{self.store}/partials/run={run}")
        live = [(r["file"], r["size"], r["changed"], r["run"] or run) for r in rows]
        generation = max([-1, *self._generations()]) + 1
        while f"gen={generation}" in children(self.spark, f"{self.store}/manifest"):  # what a refresh that died left
            generation += 1
        made = self.spark.createDataFrame(live, "file string, size bigint, changed timestamp, run string")
        made.coalesce(1).write.parquet(f"{self.store}/manifest/gen={generation}")
        return report

    def read(self) -> DataFrame:
        """The view: partials of the latest generation's files, merged by key."""
        live = self._manifest().select("file", "run")
        runs = sorted(r["run"] for r in live.select("run").distinct().collect())
        parts = [f"{m}__{p}" for m, (kind, _) in self.measures.items() for p in PARTS[kind]]
        if runs:
            rows = self.spark.read.option("basePath", f"{self.store}/partials").parquet(*[f"{self.store}/partials/run={r}" for r in runs])
            rows = rows.withColumn("run", F.col("run").cast("string"))
        else:
            rows = self._parts(self.spark.read.parquet(self.source)).where("false").withColumn("run", F.lit(""))
        merged = rows.join(live, ["file", "run"], "left_semi").groupBy(*self.keys).agg(*[MERGE[x.rpartition("__")[2]](x).alias(x) for x in parts])
        return merged.select(*self.keys, *[WHOLE[kind](lambda p, m=m: F.col(f"{m}__{p}")).alias(m) for m, (kind, _) in self.measures.items()])

    def vacuum(self) -> int:
        """Delete generations before the latest, and runs that it no longer names; how many folders that was."""
        done = self._generations()
        if not done:
            return 0
        live = {r["run"] for r in self._manifest().select("run").distinct().collect()}
        old = [f"manifest/{x}" for x in children(self.spark, f"{self.store}/manifest") if x.startswith("gen=") and int(x[4:]) < done[-1]]
        old += [f"partials/{x}" for x in children(self.spark, f"{self.store}/partials") if x.startswith("run=") and x[4:] not in live]
        for x in old:
            delete(self.spark, f"{self.store}/{x}")
        return len(old)
