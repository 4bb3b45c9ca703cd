"""Column functions and building blocks on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from civicledger.functions import keys
from civicledger.operators import graph, matching
from civicledger.operators import relational as rel
from civicledger.plans import charts, gateway, profiles, tables
from civicledger.sources import readers, sinks


def one(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_vendor_names(spark):
    names = ["DELOITTE INC.", "Deloitte & Touche LLP", "Samson Belair / Deloitte & Touche", "COFOMO OTTAWA", "EMERION-COFOMO & FMC", "X LTÉE", " ", None, "Acme Co Ltd Inc Corp", "Inc"]
    assert one(spark, names, keys.normalize_vendor) == ["DELOITTE", "DELOITTE", "DELOITTE", "COFOMO", "EMERION COFOMO AND FMC", "X LT E", None, None, "ACME CO", "INC"]


def test_entity_names(spark):
    assert one(spark, ["Société d'aide Inc. Ltd", "Food Bank Association", None], keys.normalize_entity) == ["SOCIETE D AIDE", "FOOD BANK", None]
    assert one(spark, ["ELLIS DON Inc.", "ELLISDON", "I M P GROUP"], keys.strip_key) == ["ELLISDON", "ELLISDON", "IMP"]


def test_cleaning(spark):
    assert [None if x is None else float(x) for x in one(spark, ["$1,234.50", "None", "", "12abc", "-3", None], keys.clean_money)] == [1234.5, None, None, 12.0, -3.0, None]
    assert one(spark, ["2024-01-31T00:00", "1/5/2023", "2024", "x", None], keys.clean_date) == [dt.date(2024, 1, 31), dt.date(2023, 1, 5), None, None, None]
    assert one(spark, ["123456789RR0001", "12", None], keys.bn_prefix) == ["123456789", None, None]
    assert one(spark, ["id 123456789.", "1234567890", None], keys.bn_guess) == ["123456789", None, None]
    assert one(spark, ["Health | Santé", "Health", None], keys.english_half) == ["Health", "Health", None]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", 5), ("b", "c", 4), ("c", "a", 3), ("c", "d", 9), ("d", "a", 2), ("b", "a", 1), ("a", "a", 8)], "src string, dst string, amount int")
    assert [tuple(r) for r in graph.cycles(edges, 3).collect()] == [("a", "b", "c", 5, 4, 3, 3, 12)]
    assert [tuple(r) for r in graph.cycles(edges, 4).collect()] == [("a", "b", "c", "d", 5, 4, 9, 2, 2, 20)]
    assert [tuple(r)[:4] for r in graph.reciprocal(edges).collect()] == [("a", "b", 5, 1)]
    walk = graph.largest_edge_walk(edges, spark.createDataFrame([("b",)], "node string"), 5).orderBy("hop").collect()
    assert [(r["src"], r["dst"]) for r in walk] == [("b", "c"), ("c", "d"), ("d", "a"), ("a", "a")]


def test_rolling_counts_ties_as_a_join_does(spark):
    rows = [("v", dt.date(2020, 1, 1), 10), ("v", dt.date(2020, 1, 1), 10), ("v", dt.date(2021, 1, 1), 5), ("v", dt.date(2021, 1, 2), 7)]
    df = spark.createDataFrame(rows, "k string, d date, v int")
    got = {r["d"]: (r["rows_in_window"], r["sum_in_window"]) for r in rel.rolling_forward(df, ["k"], "d", "v", 12).collect()}
    assert got == {dt.date(2020, 1, 1): (6, 50), dt.date(2021, 1, 1): (2, 12), dt.date(2021, 1, 2): (1, 7)}


def test_dml(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string"), spark.createDataFrame([(2, "B"), (3, "C"), (None, "N")], "k int, v string")
    assert {tuple(r) for r in rel.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "B"), (3, "C"), (None, "N")}
    assert {tuple(r) for r in rel.anti_insert(old, new, ["k"]).collect()} == {(3, "C")}
    df = spark.createDataFrame([(1, "x", "p"), (2, "x", "p"), (3, "x", "q"), (4, "x", None), (5, "y", None)], "i int, s string, t string")
    assert [r["t"] for r in rel.fill_by_mode(df, "s", "t").orderBy("i").collect()] == ["p", "p", "q", "p", None]


def test_backfills(spark):
    a, b = spark.createDataFrame([(1, 5), (2, 9)], "k int, v int"), spark.createDataFrame([(1, 7), (2, 3), (3, 1)], "k int, v int")
    assert {tuple(r) for r in rel.upsert_greatest(a, b, ["k"], "v").collect()} == {(1, 7), (2, 9), (3, 1)}
    target = spark.createDataFrame([(1, None), (2, 9), (4, 4)], "k int, v int")
    got = {tuple(r) for r in rel.update_where_distinct(target, spark.createDataFrame([(1, 7), (2, 9), (3, 1)], "k int, v int"), "k", "v").collect()}
    assert got == {(1, 7, True), (2, 9, False), (4, 4, False)}
    t = spark.createDataFrame([(1, "a", None, None), (2, "a", None, None), (3, None, "x", None), (4, "b", None, "old")], "id int, p string, q string, v string")
    s = spark.createDataFrame([("a", None, "2"), ("a", None, "1"), (None, "x", "3"), ("c", None, "4")], "p string, q string, v string")
    assert {(r["id"], r["v"]) for r in rel.update_paired(t, s, ["p", "q"], "id", [F.col("v")], ["v"]).collect()} == {(1, "1"), (2, "2"), (3, "3"), (4, "old")}
    full = spark.createDataFrame([(1, "x")] * 39 + [(1, None)], "s int, t string")
    assert rel.fill_by_mode(full, "s", "t").where("t IS NULL").count() == 1
    assert rel.fill_by_mode(full, "s", "t", enough=0.99).where("t IS NULL").count() == 0


def test_sinks(spark, tmp_path):
    one, two = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    path = str(tmp_path / "t")
    assert sinks.materialize(spark, one, path).count() == 2 and sinks.materialize(spark, two, path).where("k = 3").count() == 0
    assert sinks.materialize(spark, two, path, force=True).count() == 2
    assert {r["v"] for r in sinks.append_new(spark, one, path, ["k"]).collect()} == {"a", "c", "d"}
    assert {tuple(r) for r in sinks.merge(spark, spark.createDataFrame([(1, "z")], "k int, v string"), path, str(tmp_path / "u"), ["k"]).collect()} == {(1, "z"), (2, "c"), (3, "d")}
    assert sinks.shared_folder(spark).endswith(spark.sparkContext.applicationId)


def test_vector_step_takes_what_is_left(spark):
    entities = spark.createDataFrame([("charity", "Maple Leaf Housing", "MAPLE LEAF HOUSING", "1"), ("grant", "River Works", "RIVER WORKS", None), ("grant", "Ox", "OX", None)], "source string, entity_name string, name_norm string, bn string")
    left = spark.createDataFrame([(1, "MAPLE LEAF HOUSNG"), (2, "UNKNOWN PARTY"), (3, "OX"), (4, None)], "notice_id int, name_norm string")
    rows = matching.match_by_vector(left, entities).collect()
    assert [(r["notice_id"], r["entity_name"], r["method"]) for r in rows] == [(1, "Maple Leaf Housing", "vector_cosine")] and 0.72 <= rows[0]["confidence"] < 1


def test_findings_and_failed_checks(spark):
    rows = spark.createDataFrame([("zombie-recipients", 0, None, None, None), ("amendment-creep", 1234, 2.5e6, "ACME", None), ("contract-intelligence", 3, 7e9, None, 41.26)], "finding string, n long, amount double, subject string, pct double")
    got = {r["finding"]: r["text"] for r in profiles.finding_texts(rows).collect()}
    assert got == {"zombie-recipients": "Data unavailable", "amendment-creep": "ACME: grown to $2.5M; 1,234 contracts flagged", "contract-intelligence": "Services are 41.3% of categorised contracts"}
    money = spark.createDataFrame([(1.24e9,), (5600.0,), (78.0,), (-2e6,), (None,)], "x double").select(profiles.money_text(F.col("x")))
    assert [r[0] for r in money.collect()] == ["$1.2B", "$5.6K", "$78", "$-2.0M", None]
    tables = {"charities": spark.createDataFrame([("123456789RR0001", "Revoked")], "bn string, designation string")}
    flags = profiles.screen_entity(tables, "anyone", "123456789RR0001").collect()
    assert [(r["challenge"], r["severity"]) for r in flags] == [("charity_status", "high")]


def test_matching_prefers_numbers(spark):
    notices = spark.createDataFrame([(1, "ACME", "123456789"), (2, "ACME", None), (3, "ABC", None)], "notice_id int, name_norm string, bn_guess string")
    entities = spark.createDataFrame([("c", "Acme", "ACME", "123456789"), ("c", "Abc", "ABC", None)], "source string, entity_name string, name_norm string, bn string")
    assert {(r["notice_id"], r["method"]) for r in matching.match_entities(notices, entities).collect()} == {(1, "exact_bn"), (2, "exact_name")}


def test_profile(spark):
    df = spark.createDataFrame([("2024-01-01", "Ontario", "10", "yes"), ("2024-02-01", "Ontario", "15", "no"), ("2024-03-01", "Quebec", None, "yes")], "date string, province string, value string, flag string")
    p = {r["column"]: r for r in tables.profile(df).collect()}
    assert [(p[c]["type"], p[c]["role"]) for c in ("date", "province", "value", "flag")] == [("date", "time"), ("string", "geography"), ("number", "measure"), ("boolean", "category")]
    assert (p["value"]["non_null"], p["value"]["distinct"], float(p["value"]["least"])) == (2, 2, 10.0)
    assert tables.suggest_charts([r.asDict() for r in p.values()])[0] == ("line", "date", "value")


def test_charts_from_a_profile(spark):
    df = spark.createDataFrame([("2024-01-01", "Ontario", "10"), ("2024-02-01", "Ontario", "15"), ("2024-03-01", "Quebec", "12")], "date string, province string, value string")
    p = [r.asDict() for r in tables.profile(df).collect()]
    assert charts.choose_fields(p, "line") == ("date", "value", None) and charts.choose_fields(p, "bar") == ("province", "value", None)
    assert [charts.kind_of_goal(g) for g in ("trend over time", "price versus size", "top vendors", "anything", None)] == ["line", "scatter", "bar", None, None]
    assert charts.choose_aggregation(df, "date", "value") == "none" and charts.choose_aggregation(df, "province", "value") == "sum" and charts.choose_aggregation(df, "province", None) == "count"
    points, spec = charts.prepare(df, p, "trend")
    assert [tuple(r) for r in points.collect()] == [("2024-01-01", 10.0), ("2024-02-01", 15.0), ("2024-03-01", 12.0)]
    assert spec["mark"] == "line" and spec["encoding"]["x"]["type"] == "temporal"
    points, spec = charts.prepare(df, p, "compare provinces")
    assert [tuple(r) for r in points.collect()] == [("Ontario", 25.0), ("Quebec", 12.0)] and spec["encoding"]["y"]["title"] == "sum of value"
    for bad in ({"x": "nothing"}, {"y": "province"}, {"group": "value"}):
        with pytest.raises(ValueError):
            charts.choose_fields(p, "bar", **bad)
    with pytest.raises(ValueError):
        charts.choose_fields([c for c in p if c["role"] != "time"], "line")


def test_pick_chart(spark):
    kind = lambda rows, schema: charts.pick_chart(spark.createDataFrame(rows, schema))["type"]
    assert kind([(5,)], "n int") == "kpi" and kind([], "n int") == "none" and kind([("a",), ("b",)], "v string") == "table"
    assert kind([(2020, "a", 1.0), (2021, "a", 2.0)], "fiscal_year int, k string, v double") == "multi_line"
    assert kind([("a", "x", 1.0), ("b", "x", 2.0)], "k string, l string, v double") == "stacked_bar"
    assert kind([("a", 1.0), ("b", 2.0)], "k string, v double") == "bar" and kind([(2020, 1.0), (2021, 2.0)], "year int, v double") == "line"
    assert kind([(1, 1.0), (2, 2.0)], "u int, v double") == "scatter"


def test_pages_that_fail_are_left_out(spark, tmp_path):
    for offset in (0, 4):
        (tmp_path / f"{offset}.json").write_text('{"total": 6, "records": [{"id": "%d"}, {"id": "%d"}]}' % (offset, offset + 1))
    spark.dataSource.register(readers.PagedSource)
    read = lambda **o: spark.read.format("paged").options(url=str(tmp_path), schema="id string", page="2", tries="2", first="0", **o).load()
    assert sorted(r["id"] for r in read(on_error="skip").collect()) == ["0", "1", "4", "5"]
    with pytest.raises(Exception, match=".*"):
        read().collect()
    good, bad = readers.bad_rows(spark.createDataFrame([(1, None), (2, "2,x,y")], "k int, _bad string"))
    assert good.columns == ["k"] and good.count() == 1 and bad.first()[0] == 1


def test_geo(spark):
    text = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"n":"a"},"geometry":{"type":"Polygon","coordinates":[[[-80,43],[-79,43],[-79,44],[-80,43]]]}},{"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":[-71,47]}}]}'
    rows = tables.geo_features(spark.createDataFrame([(text,)], "value string")).orderBy("feature_id").collect()
    assert [tuple(r)[3:] for r in rows] == [(-80.0, 43.0, -79.0, 44.0), (-71.0, 47.0, -71.0, 47.0)]


@pytest.mark.parametrize("bad", ["DROP TABLE x", "select 1; delete from x", "/* x */ insert into t select 1", "select 1 -- \n; drop table t", "select sum(gov_funding_other) from financial", ""])
def test_guard_refuses(bad):
    with pytest.raises(ValueError):
        gateway.guard(bad)


def test_gateway(spark):
    spark.range(5).createOrReplaceTempView("numbers")
    assert gateway.guard("WITH a AS (SELECT 'drop' AS x) SELECT * FROM a;").endswith("a;")
    fixed = gateway.run(spark, "SELECT idd FROM numbers", lambda sql, error, schema: sql.replace("idd", schema["numbers"][0]))
    assert fixed.count() == 5
    events = list(gateway.run_steps(spark, [("count", "SELECT count(*) AS n FROM numbers"), ("bad", "DROP TABLE numbers")]))
    assert [k for k, _ in events] == ["status", "step_result", "status", "step_error", "rows", "done"] and events[-2][1]["rows"] == [{"n": 5}]


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿date, value\n2024-01-01,10\n2024-01-02,x\n')
    assert readers.read_csv(spark, str(tmp_path / "a.csv")).columns == ["date", "value"]
    typed = readers.read_csv(spark, str(tmp_path / "a.csv"), "date string, value int").cache()
    assert [r["_bad"] is None for r in typed.orderBy("date").collect()] == [True, False]
    (tmp_path / "b.json").write_text('{"result": {"records": [{"province": "Ontario", "total": 10}, {"province": "Quebec", "total": 8}]}}')
    assert readers.read_records(spark, str(tmp_path / "b.json")).count() == 2
    (tmp_path / "c.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert [r["a"] for r in readers.read_records(spark, str(tmp_path / "c.jsonl")).orderBy("a").collect()] == [1, 2]
    (tmp_path / "d.xml").write_text("<list><record><name>A</name></record><record><name>B</name></record></list>")
    assert {r["name"] for r in readers.read_xml(spark, str(tmp_path / "d.xml")).collect()} == {"A", "B"}
    assert [readers.detect_format("x.csv"), readers.detect_format("x", head=' {"a":1}'), readers.detect_format("x", head="a,b\n1,2"), readers.detect_format("x", "application/geo+json")] == ["csv", "json", "csv", "json"]


def test_paged_source(spark, tmp_path):
    for o in (0, 2):
        (tmp_path / f"{o}.json").write_text('{"records": [{"id": %d, "v": "None"}, {"id": %d, "v": "x"}]}' % (o, o + 1))
    spark.dataSource.register(readers.PagedSource)
    df = spark.read.format("paged").option("url", str(tmp_path)).option("page", 2).option("total", 4).option("schema", "id string, v string").load()
    assert sorted((r["id"], r["v"]) for r in df.collect()) == [("0", None), ("1", "x"), ("2", None), ("3", "x")]


def test_paged_source_reads_the_total(spark, tmp_path):
    for o in (0, 2, 4):
        records = ", ".join('{"id": %d}' % i for i in range(o, min(5, o + 2)))
        (tmp_path / f"{o}.json").write_text('{"result": {"total": 5, "records": [%s]}}' % records)
    spark.dataSource.register(readers.PagedSource)
    load = lambda at: spark.read.format("paged").option("url", str(at)).option("page", 2).option("schema", "id string").load()
    assert sorted(r["id"] for r in load(tmp_path).collect()) == ["0", "1", "2", "3", "4"]
    none = tmp_path / "none"
    none.mkdir()
    (none / "0.json").write_text('{"records": [{"id": 0}, {"id": 1}]}')
    with pytest.raises(Exception, match="states no total"):
        load(none).collect()


def test_nearest_by_blocks_is_brute_force(spark):
    import numpy as np

    from civicledger.operators import matching

    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 8))
    v[7], v[9] = v[3], 2 * v[3]
    rows = [(i, x.tolist(), "ab"[i % 2]) for i, x in enumerate(v)] + [(60, None, "a"), (61, [0.0] * 8, "b")]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, block string")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 12)
    want = {}
    for i in range(60):
        near = min((-s[i, j], j) for j in range(60) if j != i and j % 2 == i % 2)
        if -near[0] >= 0.3:
            want[i] = near[1]
    for chunk in (1024, 7):
        got = matching.nearest_by_blocks(df.withColumnRenamed("id", "left_id"), df.withColumnRenamed("id", "right_id"), 0.3, apart=True, chunk=chunk)
        assert {r["left_id"]: r["right_id"] for r in got.collect()} == want
    assert (want[3], want[7], want[9]) == (7, 3, 3)


def test_retry_backs_off():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise OSError
        return 7

    assert readers.retry(call, sleep=waits.append) == 7 and waits == [2.0, 4.0, 8.0]


def test_stream_equals_batch(spark, tmp_path):
    from civicledger.streaming import events as ev

    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    q = ev.windowed(ev.stream(spark, "/root/testdata/sf0.001", batch.schema)).writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path)).start()
    try:
        q.processAllAvailable()
        assert {(str(r[0]), *r[1:3]) for r in spark.sql("SELECT * FROM w").collect()} == {(str(r[0]), *r[1:3]) for r in ev.windowed(batch).collect()}
    finally:
        q.stop()
