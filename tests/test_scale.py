"""Work that must not grow faster than the tables: passes over contracts, and pairs that are never made."""

import datetime

import pytest

from civicledger.functions import keys
from civicledger.operators import matching
from civicledger.plans import contracts, domain, profiles
from civicledger.plans.all import VIEWS

from .conftest import SMALL, same_rows


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def passes(df):
    return len([x for x in plan_of(df).splitlines() if "Relation [" in x and "l_orderkey" in x])


def test_followon_makes_no_pairs(spark):
    """Wins and work are told apart by day, at both ends of the two years, without a join of one with the other."""
    domain._INGESTED.clear()
    rows = [
        ("1", "V", "D", "TC", "2020-02-28", 200000), ("2", "V", "D", "TN", "2020-02-28", 1), ("3", "V", "D", "TN", "2020-02-29", 10), ("4", "V", "D", "TN", "2022-02-28", None),
        ("5", "V", "D", "TN", "2022-03-01", 100), ("6", "V", "E", "TN", "2020-03-01", 1000), ("7", "W", "D", "TC", "2020-01-01", 300000), ("8", "W", "D", "TN", "2020-05-01", None),
        ("9", "X", "D", "TC", "2020-01-01", 300000), ("10", "X", "D", "TN", "2019-12-31", 7), ("11", None, "D", "TN", "2020-05-01", 7),
    ]
    t = {"contracts": spark.createDataFrame(rows, "reference_number string, normalized_vendor string, owner_org_title string, solicitation_procedure string, d string, v int").selectExpr("*", "to_date(d) AS contract_date", "CAST(v AS DECIMAL(18, 2)) AS effective_value", "CAST(v AS DECIMAL(18, 2)) AS original_value")}
    found = contracts.same_vendor_followon(t)
    got = {r["contract_key"]: (r["win_date"], r["followon_tn_count"], r["followon_tn_value"]) for r in found.collect()}
    assert got == {"1": (datetime.date(2020, 2, 28), 2, 10), "7": (datetime.date(2020, 1, 1), 1, None)}
    assert "Join" not in plan_of(found)


def test_amendments_take_one_pass(spark):
    domain._INGESTED.clear()
    assert passes(VIEWS["amendment_creep"].query(spark, SMALL)) == 1


@pytest.mark.parametrize("name", ["competitive_to_sole_source", "headline_findings"])
def test_history_holds_two_snapshots(spark, name):
    """First and last days and procedures come from the least and greatest snapshot, which are held once each."""
    domain._INGESTED.clear()
    plan = plan_of(VIEWS[name].query(spark, SMALL))
    assert "min_by(solicitation_procedure" not in plan and "min(contract_date" not in plan and passes(VIEWS[name].query(spark, SMALL)) == 1


def test_governance_flows_of_charities_that_sell(spark, tmp_path):
    """What vendors with a charity's name sold is found from the suppliers; pairs of boards meet the transfers only."""
    import duckdb

    domain._INGESTED.clear()
    for name in domain.TABLES:
        named = {"customer": "SELECT * REPLACE ('Board ' || c_custkey AS c_name)", "supplier": "SELECT * REPLACE (CASE WHEN s_suppkey % 10 < 8 THEN 'Board ' || s_suppkey * 5 || ' Society' ELSE s_name END AS s_name)"}
        duckdb.sql(f"{named.get(name, 'SELECT *')} FROM '{SMALL}/{name}.parquet'").write_parquet(f"{tmp_path}/{name}.parquet")
    view = VIEWS["governance_flow_links"]
    rows = same_rows(spark, view.query, view.oracle(), str(tmp_path))
    at = sorted(view.query(spark, SMALL).columns).index("shared_contract_value")
    assert rows and 0 < len([r for r in rows if float(r[at]) > 0]) < len(rows)
    pairs = plan_of(view.query(spark, SMALL)).splitlines()
    assert len([x for x in pairs if "Join LeftOuter" in x and "bn_x" in x]) == 1
    assert any("Join LeftSemi" in x and "l_suppkey" in x for x in pairs)


def test_screenings_share_their_passes(spark):
    """Three entities take the four passes over the contracts that one takes; a row that two ask for is told for each."""
    domain._INGESTED.clear()
    assert passes(VIEWS["screen_entity"].query(spark, SMALL)) == passes(profiles.screen_entity(domain.Domain(spark, SMALL), "brand#1", None)) == 4
    tables = {"wrongdoing": spark.createDataFrame([(i, f"Dept {i % 2}", "{}") for i in range(12)], "id long, owner_org_title string, raw_fields string")}
    got = [r["entity"] for r in profiles.screen_entities(tables, [("dept", None), ("dept 1", None), ("none", None)]).collect()]
    assert sorted(got) == ["dept"] * 5 + ["dept 1"] * 5


def test_matched_names_without_pairs(spark):
    """The names of match_entities(), once each, also of names that many notices and entities share."""
    from pyspark.sql import functions as F

    entities = spark.createDataFrame([("charity", "Same Name", f"{i:09}") for i in range(50)] + [("grant", "By Number", "123456789"), ("contract", "Neither", None), ("grant", "abc", None)], "source string, entity_name string, bn string").withColumn("name_norm", keys.normalize_entity(F.col("entity_name")))
    said = [(i, "sáme name inc", None) for i in range(50)] + [(60, "other", "123456789"), (61, "abc", None), (62, None, None)]
    notices = spark.createDataFrame(said, "notice_id int, n string, bn_guess string").select("notice_id", keys.normalize_entity(F.col("n")).alias("name_norm"), "bn_guess")
    names = matching.matched_names(notices, entities)
    assert sorted(r[0] for r in names.collect()) == sorted(r[0] for r in matching.match_entities(notices, entities).select("entity_name").distinct().collect()) == ["By Number", "Same Name"]
    assert "Inner" not in plan_of(names) and plan_of(names).count("LeftSemi") == 2
