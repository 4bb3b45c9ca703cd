"""Resumable ingestion: growth, a crash between a batch's writing and its commit, pages that fail and are repaired."""

import json

import pytest

from civicledger.sources import ingest as ing

SCHEMA = "id string, v string"


def publish(folder, total, size=2, missing=()):
    """The API's pages of `size` records, of which those in `missing` can't be had."""
    folder.mkdir(exist_ok=True)
    for o in range(0, max(total, 1), size):
        page, at = {"result": {"total": total, "records": [{"id": i, "v": f"v{i}"} for i in range(o, min(total, o + size))]}}, folder / f"{o}.json"
        at.unlink(missing_ok=True) if o in missing else at.write_text(json.dumps(page))


@pytest.fixture
def where(tmp_path):
    return tmp_path / "api", str(tmp_path / "table"), str(tmp_path / "checkpoint")


def load(spark, where, **options):
    return ing.ingest(spark, str(where[0]), where[1], where[2], SCHEMA, page=2, tries=1, **options)


def ids(spark, where):
    return sorted(int(r["id"]) for r in ing.loaded(spark, where[1], SCHEMA).collect())


def test_only_what_is_new_is_read(spark, where):
    publish(where[0], 5)
    assert load(spark, where) == 1 and ids(spark, where) == list(range(5))
    assert load(spark, where) == 1  # nothing new, no batch
    publish(where[0], 9)
    assert load(spark, where) == 2 and ids(spark, where) == list(range(9))
    rows = ing.loaded(spark, where[1], SCHEMA)
    assert {r["batch"] for r in rows.where("id >= 5").collect()} == {1} and set(rows.columns) == {"id", "v", "batch"}
    assert ing.failures(spark, where[1], SCHEMA).count() == 0


@pytest.mark.parametrize("after", [False, True])
def test_crash_between_two_batches(spark, where, monkeypatch, after):
    """The second batch dies before or after its rows are written; the batch number is the same when it is done again."""
    publish(where[0], 4)
    load(spark, where)
    publish(where[0], 7)
    write = ing._write

    def dies(rows, table, number):
        if after:
            write(rows, table, number)
        raise RuntimeError("killed")

    monkeypatch.setattr(ing, "_write", dies)
    with pytest.raises(Exception, match="killed"):
        load(spark, where)
    monkeypatch.undo()
    assert ids(spark, where) == list(range(7 if after else 4))
    publish(where[0], 8)  # the API has grown meanwhile: the batch ends where it was to end, the rest is the next one
    assert load(spark, where) >= 2 and ids(spark, where) == list(range(8))
    load(spark, where)
    assert ids(spark, where) == list(range(8))


def test_failed_pages_are_told_and_repaired(spark, where):
    publish(where[0], 3)
    load(spark, where)
    publish(where[0], 9, missing=(2, 6))  # the page of record 2 is read in part by either batch
    load(spark, where)
    assert ids(spark, where) == [0, 1, 2, 4, 5, 8]
    failed = ing.failures(spark, where[1], SCHEMA).orderBy("page").collect()
    assert [(r["batch"], r["page"], r["records"]) for r in failed] == [(1, 3, 1), (1, 6, 2)] and all(r["error"] for r in failed)
    publish(where[0], 9, missing=(6,))
    assert ing.repair(spark, str(where[0]), where[1], SCHEMA, page=2, tries=1) == 1
    assert ids(spark, where) == [0, 1, 2, 3, 4, 5, 8]
    publish(where[0], 9)
    assert ing.repair(spark, str(where[0]), where[1], SCHEMA, page=2, tries=1) == 0
    assert ids(spark, where) == list(range(9))
    assert load(spark, where) == 2


def test_start_and_empty(spark, where):
    assert ing.loaded(spark, where[1], SCHEMA).count() == 0
    publish(where[0], 0)
    load(spark, where)
    assert ids(spark, where) == []
    publish(where[0], 6)
    load(spark, (where[0], where[1] + "2", where[2] + "2"), start=3)
    assert ids(spark, (where[0], where[1] + "2")) == [3, 4, 5]


def test_stream_is_put_in_once(spark, tmp_path):
    """New files are a new batch; a batch that was written but not committed is written again under its number."""
    source, table, checkpoint = tmp_path / "s", str(tmp_path / "t"), tmp_path / "c"
    spark.range(5).coalesce(1).write.parquet(str(source))
    stream = lambda: spark.readStream.schema("id long").parquet(str(source))
    rows = lambda: sorted(r["id"] for r in spark.read.parquet(table).collect())
    for _ in range(2):
        ing.put_stream(stream(), table, str(checkpoint))
        assert rows() == list(range(5))
    spark.range(5, 9).coalesce(1).write.mode("append").parquet(str(source))
    ing.put_stream(stream(), table, str(checkpoint))
    assert rows() == list(range(9))
    for name in ("1", ".1.crc"):
        (checkpoint / "commits" / name).unlink(missing_ok=True)  # as if the run had died before the commit
    ing.put_stream(stream(), table, str(checkpoint))
    assert rows() == list(range(9))
