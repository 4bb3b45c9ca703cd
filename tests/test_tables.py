"""Cycles by degree, counted pairs, updates by ranges, kept answers, files and sources that users mean."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from civicledger.functions import keys
from civicledger.operators import graph
from civicledger.plans import charts, network
from civicledger.sources import sinks


def test_cycles_of_four_are_all_cycles(spark):
    rng = random.Random(4)
    nodes = [f"n{i:02}" for i in range(14)]
    edges = {(a, b): rng.randint(1, 99) for a in nodes for b in nodes if a != b and (rng.random() < 0.25 or a == "n03" or b == "n05")}
    edges["n00", "n00"] = 5
    want = {}
    for c in itertools.permutations(nodes, 4):
        legs = [edges.get((c[i], c[(i + 1) % 4])) for i in range(4)]
        if c[0] == min(c) and None not in legs:
            want[c] = (*legs, min(legs), sum(legs))
    df = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, amount int")
    got = graph.cycles(df, 4).collect()
    assert len(got) == len(want) and {tuple(r)[:4]: tuple(r)[4:] for r in got} == want


def test_no_half_runs_through_a_hub(spark):
    """A hub of 400 edges in and out has no cycle: no half is made of it, where there would be 160,000."""
    e = spark.range(400).select(F.concat(F.lit("a"), "id").alias("src"), F.lit("hub").alias("dst"), F.lit(1).alias("amount"))
    e = e.unionAll(spark.range(400).select(F.lit("hub"), F.concat(F.lit("b"), "id"), F.lit(1)))
    assert graph.cycles(e, 4).count() == 0


def test_counted_pairs_are_the_pairs(spark):
    t = {
        "directors": spark.createDataFrame([(f"{b:09}RR0001", f, "L", None, None, "p") for f, boards in (("A", range(1, 8)), ("B", range(3, 6)), ("C", [9])) for b in boards], "bn string, first_name string, last_name string, initials string, end_date date, position string"),
        "financial": spark.createDataFrame([], "bn string, fpe date"), "charities": spark.createDataFrame([(f"{b:09}RR0001", f"Name {b}") for b in range(1, 10)], "bn string, legal_name string"),
        "transfers": spark.createDataFrame([(f"{a:09}RR0001", f"{b:09}RR0001", 5) for a, b in ((1, 2), (2, 1), (5, 3), (4, 9), (6, 7), (3, 3))], "donor_bn string, donee_bn string, total_gifts int"),
        "grants": spark.createDataFrame([(f"{b:09}RR0001", v) for b, v in ((1, 10), (2, 20), (3, 30), (8, 1), (4, 0))], "recipient_business_number string, agreement_value int"),
        "contracts": spark.createDataFrame([], "normalized_vendor string, effective_value int"),
    }
    flows = network.governance_flow_links(t)
    money = flows.where("transfer_xy + transfer_yx > 0 OR joint_grants_value > 0").count()
    assert network.related_parties_stats(t).collect()[0]["pairs_with_financial_edge"] == money > 0
    moved = {(r["person_key"], r["bn_x"], r["bn_y"]) for r in flows.where("transfer_xy + transfer_yx > 0").collect()}
    assert {tuple(r) for r in network.transfers_within(t).collect()} == moved and moved
    about = network.governance_flow_links(t, "000000004").where("bn_x = '000000004' OR bn_y = '000000004'")
    assert sorted(map(str, about.collect())) == sorted(map(str, flows.where("bn_x = '000000004' OR bn_y = '000000004'").collect()))


def test_update_goes_on_where_it_stopped(spark, tmp_path):
    path, to = str(tmp_path / "t"), str(tmp_path / "u")
    spark.range(-3, 50).select("id", (F.col("id") * 2).alias("v"), F.lit("x").alias("w")).unionAll(spark.createDataFrame([(None, 7, "n")], "id long, v long, w string")).write.parquet(path)
    staged = spark.range(0, 60, 7).select("id", F.when(F.col("id") != 14, F.col("id") + 1000).alias("v"))
    sinks.update_by_ranges(spark, path, staged, to, "id", 20)
    marker = tmp_path / "u" / "range=20" / "_SUCCESS"
    before = marker.stat().st_mtime_ns
    (tmp_path / "u" / "range=0" / "_SUCCESS").unlink()  # this range was cut short
    got = {r["id"]: (r["v"], r["w"]) for r in sinks.update_by_ranges(spark, path, staged, to, "id", 20).collect()}
    assert marker.stat().st_mtime_ns == before
    want = {i: ((i + 1000 if i != 14 else None) if i % 7 == 0 and i >= 0 else i * 2, "x") for i in range(-3, 50)}
    assert got == want | {None: (7, "n")}


def test_answers_are_kept_until_their_inputs_change(spark, tmp_path):
    source, clock = str(tmp_path / "s"), [1000.0]
    spark.range(5).coalesce(1).write.parquet(source)
    answers = sinks.Answers(spark, str(tmp_path / "a"), 60, lambda: clock[0])
    ask = lambda: spark.read.parquet(source).agg(F.sum("id").alias("s"), F.lit(0).alias("z"))
    stored = lambda: sorted(str(p) for p in (tmp_path / "a").glob("*/at=*"))
    assert answers.get(ask()).first()["s"] == 10
    first = stored()
    assert answers.get(ask()).first()["s"] == 10 and stored() == first
    clock[0] += 61
    assert answers.get(ask()).first()["s"] == 10 and len(stored()) == 1 and stored() != first
    spark.range(100, 101).coalesce(1).write.mode("append").parquet(source)
    assert answers.get(ask()).first()["s"] == 110
    assert answers.get(ask().where("s > 1000")).count() == 0


def test_files_are_found_by_id_or_unique_name(spark):
    files = spark.createDataFrame([("d", "1", "Data"), ("d", "2", "data"), ("d", "3", "Other file"), ("e", "4", "Only")], "dataset string, id string, name string")
    assert charts.resolve_file(files, "d", "2")["name"] == "data" and charts.resolve_file(files, "d", " other  FILE ")["id"] == "3" and charts.resolve_file(files, "e")["id"] == "4"
    for dataset, wanted in (("d", "data"), ("d", None), ("d", "x"), ("e", "1"), ("f", None)):
        with pytest.raises(ValueError):
            charts.resolve_file(files, dataset, wanted)


def test_file_scores(spark):
    rows = [("CSV", None, None, True, "API"), (None, "application/pdf", "http://x/a.csv", False, None), (None, None, "http://x/a.csv?y=1#z", None, None), ("PDF", None, "http://x/q?f=geojson", False, "file"), ("GeoJSON", None, "", False, "api"), ("html", "text/html", "", False, None)]
    df = spark.createDataFrame(rows, "format string, mime string, url string, datastore boolean, kind string")
    score = lambda **how: [r[0] for r in df.select(charts.file_score(**how)).collect()]
    assert score() == [160, 0, 100, 0, 140, 80]
    assert score(for_maps=True) == [160, 0, 100, 60, 245, 80] and score(for_analysis=False) == [150, 0, 100, 0, 140, 100]


def test_sources_of_a_topic(spark):
    rows = [("contracts", "Contracts over a limit", "Spending on goods", "spending", ["consulting"]), ("travel", "Travel expenses", "Trips of officials", "travel", ["flights"]), ("notes", "Briefing notes", "Titles", "briefing", ["memo"])]
    sources = spark.createDataFrame(rows, "id string, title string, description string, domain string, examples array<string>")
    found = lambda topic: sorted(r["id"] for r in charts.sources_of_topic(sources, topic).collect())
    assert found("contract") == ["contracts"] and found("TRAVEL") == ["travel"] and found("cheap consulting work") == ["contracts"]
    assert found("minister budget") == ["contracts", "notes"] and found("zzz") == []


def test_numbered_fields(spark):
    rows = spark.createDataFrame([('{"BN": "1", "4120": "5", "300": null, "1000": 7, "30": "x", "12345": "y"}',), ('{"a": 1}',), ("no json",), (None,)], "r string").select(keys.numbered_fields(F.col("r")).alias("x")).collect()
    assert [r["x"] for r in rows] == ['{"300":null,"1000":"7","4120":"5"}', None, None, None]
