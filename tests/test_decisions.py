"""Guards, checks with answers of their own, filters that users mean, charts that are picked, names beyond ASCII."""

import time

import pytest
from pyspark.sql import functions as F

from civicledger.functions import keys
from civicledger.operators import matching
from civicledger.plans import charts, gateway, grants, guarded, profiles, search

KEPT = [
    "select x from t where note='/* keep */'", "select 'a -- b' as x, 1 as y", "select ';' as x, \"drop it\" y from t", "WITH a AS (SELECT 'drop' AS x) SELECT * FROM a;", "select 1 /* ; drop */ -- delete\n",
    "select gov_funding_other AS other_revenue from f", "select gov_funding_federal + 1 as x from f", "select sum(gov_funding_federal) as gov_funding from f", "select `drop` from t",
]
REFUSED = [
    "select 1; /* x */ DROP TABLE a", "/* select */ DROP TABLE a", "-- select\ndelete from a", "select 1; select 2", "EXECUTE x", "select 1 where exec", "explain select 1",
    "select gov_funding_federal + gov_funding_provincial from f", "select avg(gov_funding_provincial) from f", "select sum(coalesce(gov_funding_other,0)) from f", "select gov_funding_provincial + (2 * gov_funding_other) as other_revenue from f",
    "select gov_funding_other as gov_funding from f", "select gov_funding_other from f", "with a as (select max(f.gov_funding_other) m from f) select m as other_revenue from a", "select (select SUM(gov_funding_other) from f) as other_revenue",
    "select 1 as other_revenue from a where exists (select 1 from f having min(gov_funding_provincial) > 2)", "select gov_funding_other + 0 as total_government_revenue from f /* other_revenue */",
]


@pytest.mark.parametrize("sql", KEPT)
def test_statements_run_as_given(spark, sql):
    assert gateway.guard(sql, spark) == sql.strip()


@pytest.mark.parametrize("sql", REFUSED)
def test_statements_that_are_refused(spark, sql):
    with pytest.raises(ValueError):
        gateway.guard(sql, spark)


def test_literals_reach_spark_untouched(spark):
    r = gateway.run(spark, "select 'a -- b /* c */' as x, '; drop' as y").first()
    assert tuple(r) == ("a -- b /* c */", "; drop")


def test_a_failing_and_a_hanging_check_leave_the_others_answers(spark):
    def slow(batches):
        time.sleep(60)
        yield from batches

    def raises():
        raise KeyError("no such table")

    good = {f"good{i}": (lambda i=i: spark.range(i)) for i in range(6)}
    bad = {
        "fails while it runs": lambda: spark.range(3).select(F.raise_error(F.lit("broken")).alias("x")), "fails when planned": lambda: spark.table("no_such_table"), "isn't there": raises,
        "hangs in a job": lambda: spark.range(2).mapInPandas(slow, "id long"), "hangs outside": lambda: time.sleep(60) or spark.range(1),
    }
    began = time.monotonic()
    got = {r["check"]: r for r in guarded.run_checks(spark, good | bad, seconds=25)}
    assert time.monotonic() - began < 40 and list(got) == [*good, *bad]
    assert all(got[n]["ok"] and len(got[n]["rows"]) == i for i, n in enumerate(good))
    assert not any(got[n]["ok"] or got[n]["rows"] for n in bad)
    assert "broken" in got["fails while it runs"]["error"] and "25 s" in got["hangs in a job"]["error"] and "25 s" in got["hangs outside"]["error"] and "KeyError" in got["isn't there"]["error"]
    deadline = time.monotonic() + 20
    while spark.sparkContext.statusTracker().getActiveJobsIds() and time.monotonic() < deadline:
        time.sleep(0.5)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()  # the hanging one was cancelled


def test_screening_with_status(spark):
    tables = {"charities": spark.createDataFrame([("123456789RR0001", "Revoked")], "bn string, designation string"), "wrongdoing": spark.createDataFrame([(1, "Dept", "{")], "id long, owner_org_title string, raw_fields string").withColumn("id", F.when(F.col("id") > 0, F.raise_error(F.lit("bad block"))))}
    got = {r["check"]: r for r in profiles.screen_with_status(spark, tables, "dept", "123456789RR0001", 60)}
    assert len(got) == 9 and got["charity_status"]["ok"] and got["charity_status"]["rows"][0]["challenge"] == "charity_status"
    assert not got["wrongdoing"]["ok"] and "bad block" in got["wrongdoing"]["error"] and not got["zombie"]["ok"]


def test_commitment_without_a_grant_is_unknown(spark):
    t = {
        "grants": spark.createDataFrame([("Housing aid", None, "2020-05-01", 10), ("Housing aid", "x", "2021-05-01", 30), ("Housing end", None, "2022-01-01", 7), ("Other", "dental plan", "2020-06-01", None)], "prog_name_en string, description_en string, d string, agreement_value int").withColumn("agreement_start_date", F.to_date("d")),
        "policy_targets": spark.createDataFrame([("h", 100, "2020-01-01", "2022-01-01", "housing", 50.0), ("d", 100, "2020-01-01", "2022-01-01", "dental", 20.0)], "id string, total_commitment_cad int, a string, b string, match_regex string, annual_target double").withColumns({"target_start": F.to_date("a"), "target_end": F.to_date("b")}),
    }
    got = {r["id"]: r for r in grants.policy_alignment(t).collect()}
    columns = ("total_matched", "grant_count", "years_observed", "annual_actual", "annual_gap", "gap_pct")
    assert tuple(got["h"][c] for c in columns) == (40, 2, 2, 20.0, 30.0, 60.0)
    assert tuple(got["d"][c] for c in columns) == (0, 0, 1, None, None, None)


def test_filter_names():
    assert [search.filter_name(x) for x in ("Organization", "Format", "API enabled", "subject_en", "nothing", "API-enabled")] == ["owner_org", "resource_format", "datastore_enabled", "subject_en", None, "datastore_enabled"]
    assert search.filter_name("Own heading", {"x": "Own Heading"}) == "x"


def test_filter_values(spark):
    options = spark.createDataFrame([("f", "CSV", "CSV"), ("f", "CSVX", "Csv extended"), ("f", "GEO", "GeoJSON"), ("o", "nrcan", "Natural Resources"), ("o", "sc", "Statistics"), ("o", "csv", "None")], "filter string, value string, label string")
    asked = spark.createDataFrame([("f", "csv"), ("f", "geo-j"), ("f", "cs"), ("f", "json"), ("o", "resources"), ("o", "s"), ("o", "x"), ("o", "at"), ("f", "")], "filter string, said string")
    got = {(r["filter"], r["said"]): (r["how"], r["value"], r["candidates"]) for r in search.resolve(options, asked).collect()}
    assert got == {("f", "csv"): ("equal", "CSV", 2), ("f", "geo-j"): ("begins", "GEO", 1), ("f", "cs"): ("none", None, 2), ("f", "json"): ("inside", "GEO", 1), ("o", "resources"): ("inside", "nrcan", 1), ("o", "s"): ("begins", "sc", 3), ("o", "x"): ("none", None, 0), ("o", "at"): ("none", None, 2), ("f", ""): ("none", None, 0)}


def test_rates_are_averaged(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "k string, success_rate double")
    how = lambda y, goal=None: charts.choose_aggregation(df.withColumnRenamed("success_rate", y), "k", y, goal=goal)
    assert [how(y) for y in ("success_rate", "share %", "Percent done", "mean_age", "pct", "value")] == ["avg"] * 5 + ["sum"]
    assert how("value", "average by k") == "avg" and charts.choose_aggregation(df, "k", "success_rate", asked="max") == "max"


def test_picked_charts(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    two = frame([("a", "x", 1.0), ("b", "y", 2.0)], "k string, l string, v double")
    assert charts.pick_chart(two) == {"type": "stacked_bar", "x": "k", "y": "v", "series": "l"}
    assert charts.pick_chart(two, {"type": "grouped_bar", "title": "T"}) == {"type": "grouped_bar", "x": "k", "y": "v", "series": "l", "title": "T"}
    assert charts.pick_chart(frame([("2020", "5", None), ("2021", "7", None)], "fiscal string, n string, e string")) == {"type": "line", "x": "fiscal", "y": "n"}
    many = frame([(f"s{i % 12}", 2000 + i % 3, float(i)) for i in range(60)], "s string, year int, v double")
    spec = charts.pick_chart(many)
    assert spec["type"] == "multi_line" and {r["s"] for r in charts.chart_rows(many, spec).collect()} == {f"s{i}" for i in range(5, 12)} | {"Other"}
    years = frame([(1800, 1.0), (2026, 2.0), (2010, 3.0), (2030, 4.0), (None, 5.0)], "year int, v double")
    assert [r["year"] for r in charts.chart_rows(years, charts.pick_chart(years), 2024).collect()] == [None, 2010, 2026]
    bars = frame([(f"k{i:02}", float(i % 40)) for i in range(40)], "k string, v double")
    assert [r["v"] for r in charts.chart_rows(bars, charts.pick_chart(bars)).collect()] == [float(x) for x in range(39, 14, -1)]


def test_chart_hints():
    sql, hint = charts.chart_hint('```sql\n-- CHART: {"type":"bar","x":"a","y":"b"}\nSELECT 1\n-- chart : {"type":"grouped_bar","series":"s","title":"","x":5}\n```')
    assert sql == "SELECT 1" and hint == {"type": "grouped_bar", "series": "s"}
    assert charts.chart_hint('SELECT 1 -- CHART: {"type":"bar"}')[1] is None and charts.chart_hint('-- CHART: {"type":"pie"}\nSELECT 1') == ("SELECT 1", None)
    assert charts.chart_hint("-- CHART: {not json}\nSELECT 1") == ("SELECT 1", None)


def test_names_beyond_the_listed_letters(spark):
    """Composed and decomposed accents, and letters that normalising doesn't know, on either side."""
    composed, decomposed = "Énergie Řeka Ltd", "Énergie Řeka"
    entities = spark.createDataFrame([("charity", composed, None), ("grant", "ENERGIE REKA", "1"), ("grant", "Ľubľana", None), ("grant", "Other Name", None)], "source string, entity_name string, bn string").withColumn("name_norm", keys.normalize_entity(F.col("entity_name")))
    notices = spark.createDataFrame([(1, decomposed), (2, "energie reka inc."), (3, "LUBLANA"), (4, "Öther Nâme"), (5, "Nobody")], "notice_id int, n string").select("notice_id", keys.normalize_entity(F.col("n")).alias("name_norm"), F.lit(None).cast("string").alias("bn_guess"))
    got = sorted((r["notice_id"], r["entity_name"]) for r in matching.match_entities(notices, entities).collect())
    assert got == sorted([(1, composed), (1, "ENERGIE REKA"), (2, composed), (2, "ENERGIE REKA"), (3, "Ľubľana"), (4, "Other Name")])
