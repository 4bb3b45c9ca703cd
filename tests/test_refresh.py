"""Kept views against full rebuilds after appends, changes and deletions of files; contracts that are never stale."""

import os
import shutil
from pathlib import Path

import pytest

from civicledger.plans import domain
from civicledger.plans.all import VIEWS
from civicledger.sources import refresh

from .conftest import SMALL

KEYS = {"status": "o_orderstatus", "year": "year(o_orderdate)"}
MEASURES = {"n": ("count", "1"), "total": ("sum", "CAST(o_totalprice AS DECIMAL(18, 2))"), "least": ("min", "o_totalprice"), "last": ("max", "o_orderdate"), "mean": ("avg", "o_totalprice"), "known": ("count", "nullif(o_orderpriority, '5-LOW')")}
PLAIN = """SELECT o_orderstatus AS status, year(o_orderdate) AS year, count(1) AS n, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS total, min(o_totalprice) AS least, max(o_orderdate) AS last,
  avg(o_totalprice) AS mean, count(nullif(o_orderpriority, '5-LOW')) AS known FROM {o} WHERE o_custkey > 10 GROUP BY ALL"""


def rows(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


@pytest.fixture
def kept(spark, tmp_path):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    source = str(tmp_path / "orders")
    orders.where("o_orderkey % 3 = 0").repartition(4).write.parquet(source)
    return refresh.KeptView(spark, source, str(tmp_path / "store"), KEYS, MEASURES, "o_custkey > 10"), orders, source


def same(spark, view):
    got = rows(view.read())
    assert got == rows(spark.sql(PLAIN, o=spark.read.parquet(view.source)))
    return got


def test_append_change_and_delete(spark, kept):
    view, orders, source = kept
    assert view.refresh() == {"new": 4, "changed": 0, "gone": 0, "kept": 0}
    first = same(spark, view)
    orders.where("o_orderkey % 3 = 1").repartition(2).write.mode("append").parquet(source)
    assert rows(view.read()) == first  # until it is refreshed
    assert view.refresh() == {"new": 2, "changed": 0, "gone": 0, "kept": 4}
    second = same(spark, view)
    assert second != first
    files = sorted(Path(source).glob("*.parquet"))
    files[0].unlink()
    shutil.copy(files[2], files[1])  # a file's rows are replaced
    (Path(source) / f".{files[1].name}.crc").unlink(missing_ok=True)
    (Path(source) / f".{files[1].name}.crc").unlink(missing_ok=True)
    os.utime(files[1], (1, 1))
    assert view.refresh() == {"new": 0, "changed": 1, "gone": 1, "kept": 4}
    same(spark, view)
    assert view.refresh() == {"new": 0, "changed": 0, "gone": 0, "kept": 5}
    assert view.vacuum() >= 2
    same(spark, view)
    for f in Path(source).glob("*.parquet"):
        f.unlink()
    orders.limit(0).coalesce(1).write.mode("append").parquet(source)
    view.refresh()
    assert same(spark, view) == []


def test_only_new_files_are_read(spark, kept):
    view, orders, source = kept
    view.refresh()
    read = []
    parquet = type(spark.read).parquet
    try:
        type(spark.read).parquet = lambda self, *paths, **how: read.append(paths) or parquet(self, *paths, **how)
        orders.where("o_orderkey % 3 = 2").coalesce(1).write.mode("append").parquet(source)
        view.refresh()
    finally:
        type(spark.read).parquet = parquet
    assert [len(x) for x in read if any(source in p for p in x)] == [1]


@pytest.mark.parametrize("step", ["partials", "manifest"])
def test_refresh_that_dies(spark, kept, step, monkeypatch):
    """What is half written counts for nothing, before the generation's end as before its beginning."""
    view, orders, source = kept
    view.refresh()
    before = same(spark, view)
    orders.where("o_orderkey % 3 = 1").coalesce(1).write.mode("append").parquet(source)
    if step == "partials":
        monkeypatch.setattr(type(orders), "coalesce", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            view.refresh()
        monkeypatch.undo()
    else:
        view.refresh()
        last = sorted(Path(view.store, "manifest").glob("gen=*"))[-1]
        (last / "_SUCCESS").unlink()
    assert rows(view.read()) == before
    assert view.refresh()["new"] == 1
    same(spark, view)


def test_contracts_are_never_stale(spark, tmp_path):
    folder = str(tmp_path / "sf")
    shutil.copytree(SMALL, folder)
    count = lambda: VIEWS["sole_source_count"].query(spark, folder).collect()[0].asDict()
    plain = count()
    domain.ingest_contracts(spark, folder)
    assert count() == plain and any(plain.values())
    none = spark.read.parquet(f"{SMALL}/orders.parquet").limit(0).toPandas()
    before = spark.read.parquet(f"{SMALL}/orders.parquet").schema
    shutil.rmtree(f"{folder}/orders.parquet") if os.path.isdir(f"{folder}/orders.parquet") else os.unlink(f"{folder}/orders.parquet")
    spark.createDataFrame(none, before).coalesce(1).write.parquet(f"{folder}/orders.parquet")
    assert not any(v for v in count().values())
    domain.ingest_contracts(spark, folder)
    assert not any(v for v in count().values())


def test_no_job_while_a_query_is_built(spark):
    domain._INGESTED.clear()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    try:
        for name in ("sole_source_count", "contract_history", "vendor_concentration_by_category"):
            VIEWS[name].query(spark, SMALL)
        jobs = tracker.getJobIdsForGroup("building")
        stages = [i for j in jobs for i in tracker.getJobInfo(j).stageIds]
        assert all(tracker.getStageInfo(i) is None or tracker.getStageInfo(i).name.startswith("parquet") for i in stages)  # reading a schema
    finally:
        spark.sparkContext.setJobGroup("rest", "")
