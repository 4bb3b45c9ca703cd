"""Every registered view against its oracle, and properties of their results."""

import pytest

from civicledger.plans import domain
from civicledger.plans.all import VIEWS

from .conftest import SMALL, same_rows


@pytest.mark.parametrize("name", [n for n, v in VIEWS.items() if v.body])
def test_oracle(spark, name):
    rows = same_rows(spark, VIEWS[name].query, VIEWS[name].oracle())
    if name not in ("search_contracts", "vendor_name_dupes", "contract_search_summary"):
        assert rows


def test_vendor_names_are_normalised_once(spark):
    """Views over ingested contracts read stored names; without, only distinct names are normalised."""
    domain._INGESTED.clear()
    plan = VIEWS["contract_history"].query(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    patterned = [x for x in plan.splitlines() if "regexp_replace" in x]
    assert patterned and all("Aggregate [vendor_name" in x for x in patterned)
    domain.ingest_contracts(spark, SMALL)
    for name in ("vendor_concentration_by_category", "contract_history", "same_vendor_followon"):
        plan = VIEWS[name].query(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_replace" not in plan and "DELOITTE" not in plan


def test_bennet_identity(spark):
    for r in VIEWS["contract_growth_decomposition"].query(spark, SMALL).collect():
        assert abs(r["volume_component"] + r["unit_cost_component"] - r["delta_total"]) < 1e-2


def test_concentration_bounds(spark):
    rows = VIEWS["vendor_concentration_by_category"].query(spark, SMALL).where("rnk = 0").collect()
    assert rows and all(0 < r["hhi"] <= 10000 and r["cr4"] <= r["cr10"] <= 100.0001 for r in rows)


@pytest.mark.parametrize(("name", "nodes"), [("funding_triangles", "abc"), ("funding_chains_4", "abcd")])
def test_cycles_once(spark, name, nodes):
    rows = [tuple(r[f"bn_{x}"] for x in nodes) for r in VIEWS[name].query(spark, SMALL).collect()]
    assert len({frozenset(r) for r in rows}) <= len(rows) == len(set(rows))
    assert all(r[0] == min(r) and len(set(r)) == len(nodes) for r in rows)


@pytest.mark.parametrize(("name", "key"), [("contract_history", ["contract_key"]), ("threshold_splitting", ["normalized_vendor", "owner_org_title", "label"]), ("director_board_links", ["person_key", "bn_prefix"]), ("purpose_cluster", ["recip_key", "purpose_cluster"])])
def test_keys_are_unique(spark, name, key):
    df = VIEWS[name].query(spark, SMALL)
    assert df.count() == df.select(*key).distinct().count()


@pytest.mark.parametrize("sent", [0, 4 << 20])
def test_contracts_meet_their_tables_once(spark, monkeypatch, sent):
    """Lineitem is read once and contracts are never shuffled by name; without names sent, once more by supplier."""
    domain._INGESTED.clear()
    monkeypatch.setattr(domain, "SENT_BYTES", sent)
    df = VIEWS["contract_history"].query(spark, SMALL)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey") and len([x for x in plan.splitlines() if "Relation [" in x and "l_orderkey" in x]) == 1
    assert not [x for x in plan.splitlines() if "Join" in x and "vendor_name" in x]
    assert ("rightHint=(strategy=broadcast)" in plan) == bool(sent)
    same_rows(spark, VIEWS["contract_history"].query, VIEWS["contract_history"].oracle())


def test_vendors_of_odd_suppliers(spark, tmp_path):
    """Repeated suppliers multiply contracts, as joins do; those without a name have contracts without a vendor."""
    domain._INGESTED.clear()
    folder = str(tmp_path / "sf")
    s = spark.read.parquet(f"{SMALL}/supplier.parquet")
    odd = s.selectExpr("s_suppkey", "CASE WHEN s_suppkey = 4 THEN NULL WHEN s_suppkey = 5 THEN ' ' ELSE s_name END AS s_name", "s_nationkey", "s_acctbal")
    odd = odd.unionByName(odd.where("s_suppkey IN (6, 7)")).unionByName(s.where("s_suppkey = 7").selectExpr("s_suppkey", "'Other Co' AS s_name", "s_nationkey", "s_acctbal"))
    for t in domain.CONTRACT_TABLES:
        (odd if t == "supplier" else spark.read.parquet(f"{SMALL}/{t}.parquet")).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
    got = domain.contracts_with_vendor(spark, folder)
    want = domain.Domain(spark, folder).bound("contracts")
    want = want.withColumn("normalized_vendor", domain.keys.normalize_vendor(want["vendor_name"])).select(*got.columns)
    assert got.where("vendor_name IS NULL").count() and got.where("normalized_vendor = 'OTHER'").count()
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


@pytest.mark.parametrize("name", ["contract_bucket_yearly", "contract_yoy_decomposition", "latest_bucket_changes"])
def test_buckets_scan_contracts_once(spark, name):
    """Top pairs, totals, shares and the last year are taken from one pass over the contracts."""
    domain._INGESTED.clear()
    plan = VIEWS[name].query(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert len([x for x in plan.splitlines() if "Relation [" in x and "l_orderkey" in x]) == 1
