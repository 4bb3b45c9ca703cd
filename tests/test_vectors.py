"""The inverted file against brute force: exact search, recall of a few lists, odd vectors, and its plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from civicledger.operators import matching, vectors
from civicledger.plans.all import VIEWS

from .conftest import SMALL


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(11)
    middles = rng.normal(size=(60, 24))
    v = np.concatenate([middles[rng.integers(0, 60, 3000)] + 0.35 * rng.normal(size=(3000, 24)), rng.normal(size=(500, 24))])
    v[10] = v[20] = 3 * v[30]  # the same direction: ties
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def index(spark, points):
    rows = [(i, x.tolist()) for i, x in enumerate(points)] + [(9001, None), (9002, [0.0] * 24), (9003, [float("nan")] * 24), (9004, [None] * 24)]
    return vectors.build(spark.createDataFrame(rows, "id long, embedding array<double>"), lists=50)


def asked(spark, points):
    q = points[::25] + 0.05 * np.random.default_rng(12).normal(size=points[::25].shape)
    s = np.round(q / np.linalg.norm(q, axis=1, keepdims=True) @ points.T, 12)
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)] + [(900, None), (901, [0.0] * 24)], "id long, embedding array<double>"), s.argmax(1), s.max(1)


def test_exact_search_is_brute_force(spark, points, index):
    q, near, most = asked(spark, points)
    got = {r["id"]: (r["near"], r["similarity"]) for r in index.nearest(q, probes=1, exact=True).collect()}
    assert sorted(got) == list(range(len(near)))
    assert all(got[i][0] == near[i] and abs(got[i][1] - most[i]) < 1e-9 for i in got)
    above = {r["id"] for r in index.nearest(q, probes=1, least=0.97, exact=True).collect()}
    assert above == {i for i, m in enumerate(most) if m >= 0.97}


def test_few_lists_find_nearly_all(spark, points, index):
    q, near, _ = asked(spark, points)
    got = {r["id"]: r["near"] for r in index.nearest(q).collect()}
    assert np.mean([got.get(i) == x for i, x in enumerate(near)]) >= 0.95


def test_every_vector_is_stored_once(index):
    rows = index.table.select("list", "part", F.explode("ids").alias("id")).collect()
    assert len(rows) == 3500 and len({r["id"] for r in rows}) == 3500
    assert index.table.count() == index.parts.sum()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id string, embedding array<double>")
    some = spark.createDataFrame([("a", [1.0, 2.0])], "id string, embedding array<double>")
    assert vectors.build(none).nearest(some, exact=True).count() == 0
    assert vectors.build(some).nearest(none).count() == 0
    assert [tuple(r) for r in vectors.build(some, lists=3).nearest(some, exact=True).collect()] == [("a", "a", 1.0)]


def test_long_list_in_chunks(spark):
    """All vectors in one list: as many rows of the join as chunks, and the smallest of equal ids is found."""
    same = spark.range(3000).select("id", F.array(F.lit(1.0), F.lit(0.5)).alias("embedding"))
    index = vectors.build(same, lists=1)
    assert index.table.count() == 3 and [tuple(r) for r in index.nearest(same.where("id = 7")).collect()] == [(7, 0, 1.0)]


def test_no_pair_of_names_is_a_row(spark):
    df = VIEWS["adverse_media_vector_matches"].query(spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    loops = [x for x in plan.splitlines() if "CartesianProduct" in x or "NestedLoop" in x]
    assert all("l_orderkey" in x for x in loops)  # the binding's three snapshots of a contract, no join of names
    notices = spark.createDataFrame([(i, f"MAPLE LEAF HOUSNG {i}") for i in range(50)], "notice_id int, name_norm string")
    entities = spark.createDataFrame([("grant", f"Maple Leaf Housing {i}", f"MAPLE LEAF HOUSING {i}", None) for i in range(50)], "source string, entity_name string, name_norm string, bn string")
    quick = matching.match_by_vector(notices, entities, exact=False)
    assert {r["notice_id"] for r in quick.collect()} == set(range(50))


def test_a_worker_routes_groups_one_by_one(spark, monkeypatch):
    """Each group leaves the worker as a row of its own, once for a list and not once for each of its chunks."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 8)))], "id long, embedding array<double>")
    monkeypatch.setattr(vectors, "CHUNK", 8)
    monkeypatch.setattr(vectors, "SPAN", 2)
    index = vectors.build(df, lists=4)
    assert index.parts.sum() > 40
    groups = index._routed(df.withColumn("found", F.lit(None).cast("double")), 4, False, -1.0)
    assert groups.count() <= 4 * (600 // 8 + 8) and groups.columns == ["list", "asked", "rows"]
    got = {r["id"]: (r["near"], r["similarity"]) for r in index.nearest(df, probes=1, exact=True).collect()}
    assert len(got) == 600 and all(i == near and s == 1.0 for i, (near, s) in got.items())


def test_chunks_are_packed_stored_and_met_in_bounded_lots(spark, monkeypatch, tmp_path):
    """Rows of megabytes: a hash aggregate, a reader's batch and a broadcast would each hold as many as their number allows."""
    import pyarrow.parquet as pq

    rng = np.random.default_rng(8)
    v = rng.integers(0, 2, (800, 8)).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>").coalesce(1)
    monkeypatch.setattr(vectors, "CHUNK", 8)
    monkeypatch.setattr(vectors, "STORED", 5, raising=False)
    index = vectors.build(df, lists=2, path=str(tmp_path / "lists"))
    groups = [f.metadata.row_group(i).num_rows for f in map(pq.ParquetFile, (tmp_path / "lists").glob("*.parquet")) for i in range(f.metadata.num_row_groups)]
    assert sum(groups) == index.parts.sum() > 50 and max(groups) <= 5
    asked = df.where("id < 40").withColumn("found", F.lit(None).cast("double"))
    met = index._met(index._routed(asked, 2, False, -1.0), -1.0)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    s = np.round(unit[:40] @ unit.T, 12)
    got = {r["id"]: (r["near"], r["similarity"]) for r in index.nearest(df.where("id < 40"), probes=1, exact=True).collect()}
    want = {i: (s[i].argmax(), s[i].max()) for i in range(40) if v[i].any()}
    assert got == want


@pytest.mark.parametrize("before", [0, 1])
def test_odd_rows_of_vectors(before):
    import pyarrow as pa

    nan = float("nan")
    rows = [[3.0, 4.0], None, [0.0, 2.0], [], [0.0, 0.0], [None, 1.0], [nan, 2.0], [float("inf"), 1.0], [1.0, 0.0]]
    column = lambda *x: pa.array([[9.0, 9.0]] * before + list(x), pa.list_(pa.float64())).slice(before)
    at, unit = vectors.unit_rows(column(*rows))
    assert at.tolist() == [0, 2, 8] and unit.tolist() == [[0.6, 0.8], [0.0, 1.0], [1.0, 0.0]]
    assert vectors.unit_rows(column(*rows, [0.0, 0.0, 0.0], [None]))[0].tolist() == [0, 2, 8]
    for none in ((), (None, []), ([nan],), ([0.0], [None, 1.0])):
        assert [len(x) for x in vectors.unit_rows(column(*none))] == [0, 0]
    with pytest.raises(ValueError):
        vectors.unit_rows(column([1.0, 2.0], [1.0]))


@pytest.mark.parametrize("many", [False, True])
def test_matches_by_vector_broadcast_names_only(spark, monkeypatch, many):
    """Notices and entities are stored in files far smaller than their rows; neither is broadcast, whatever Spark's limit."""
    notices = spark.range(3000).select(F.col("id").alias("notice_id"), F.concat(F.lit("MAPLE LEAF HOUSNG "), F.col("id") % 20).alias("name_norm"))
    entities = spark.range(500).selectExpr("'grant' AS source", "'Maple Leaf Housing ' || id AS entity_name", "'MAPLE LEAF HOUSING ' || id AS name_norm", "CAST(NULL AS STRING) AS bn")
    monkeypatch.setattr(matching, "SENT_ROWS", 10 if many else 100, raising=False)
    df = matching.match_by_vector(notices, entities)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") == (2 if many else 0) and plan.count("strategy=broadcast") == (0 if many else 2)
    assert ("BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()) != many
    rows = df.collect()
    assert len(rows) == 3000 and len({(r["notice_id"] % 20, r["entity_name"], r["confidence"]) for r in rows}) == 20


def test_matched_notices_are_not_broadcast(spark, monkeypatch):
    """The ids of all matched notices, which grow with the notices, are merged with them and not sent by their files' size."""
    from civicledger.plans import domain, entities

    seen = []
    monkeypatch.setattr(matching, "match_by_vector", lambda left_over, known: seen.append(left_over) or spark.createDataFrame([], "notice_id long, source string, entity_name string, bn string, method string, confidence double"))
    every = entities.adverse_media_all_matches(domain.Domain(spark, SMALL))
    joins = [x for x in seen[0]._jdf.queryExecution().executedPlan().toString().splitlines() if "LeftAnti" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)
    left, matched = ({r[0] for r in df.select("notice_id").collect()} for df in (seen[0], every))
    assert left and matched and not left & matched
