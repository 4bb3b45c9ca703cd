"""Full-text search against a plain version; the stored index reads only its terms' buckets; a page and its total."""

import math
import re

import pytest
from pyspark.sql import functions as F

from civicledger.operators import fulltext
from civicledger.plans import search

ROWS = [
    (1, "Affordable housing for seniors", "Toronto"), (2, "Rapid transit and housing", None), (3, "rapid Transit", "Québec"), (4, None, None), (5, "", "housing, housing; HOUSING!"), (6, "transit rapid transit rapid", "x"),
    (7, "Étude du logement à Québec", None), (8, "seniors for housing affordable", "Toronto"), (9, "a b a b a b c", None),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(*r, 0) for r in ROWS], "id long, title string, place string, term int")


def plain(q):
    docs = {k: re.findall(r"[^\W_]+", " ".join(x for x in (a, b) if x is not None).lower()) for k, a, b in ROWS}
    wanted = fulltext.request(q)
    words = {w for c in wanted for a in c for w in a}
    df = {w: sum(w in d for d in docs.values()) for w in words}
    mean, out = sum(map(len, docs.values())) / len(docs), {}
    for k, d in docs.items():
        if wanted and all(any(any(d[i : i + len(a)] == list(a) for i in range(len(d))) for a in c) for c in wanted):
            out[k] = round(sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * d.count(w) * 2.2 / (d.count(w) + 1.2 * (0.25 + 0.75 * len(d) / mean)) for w in words if w in d), 9)
    return out


@pytest.mark.parametrize("q", ["housing", "HOUSING transit", '"rapid transit"', 'seniors OR "rapid transit"', "québec", '"a b c" OR "for housing"', '"b a b c"', "nothing", "", '"" OR housing', "toronto OR québec housing OR étude"])
def test_search_is_the_plain_one(spark, rows, tmp_path, q):
    own = fulltext.index(rows, "id", "title", "place")
    want = plain(q)
    for index in (own, fulltext.store(own, str(tmp_path / "i"))):
        got = {r["key"]: round(r["score"], 9) for r in fulltext.search(index, fulltext.request(q)).collect()}
        assert got == want
        assert [r["key"] for r in fulltext.page(fulltext.search(index, fulltext.request(q)), 3, 1).collect()] == sorted(want, key=lambda k: (-want[k], k))[1:4]


def test_request():
    assert fulltext.request('a "b c" OR d OR e f') == [[("a",)], [("b", "c"), ("d",), ("e",)], [("f",)]]
    assert fulltext.request("OR x, OR") == [[("x",)]]


def test_stored_index_is_pruned(spark, rows, tmp_path):
    index = fulltext.store(fulltext.index(rows, "id", "title", "place"), str(tmp_path / "i"))
    plan = fulltext.search(index, fulltext.request("housing"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan) and "EqualTo(term,housing)" in plan


def test_filter_goes_below_the_grouping(spark, rows):
    plan = fulltext.index(rows, "id", "title").of(["housing"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Filter") and "housing" in plan[plan.index("Filter") :]


def test_empty_table(spark, rows):
    assert fulltext.search(fulltext.index(rows.where("false"), "id", "title"), fulltext.request("a")).count() == 0


def test_page_with_total(spark):
    c = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").where("c_acctbal > 0")
    got = search.page_with_total(c, [F.desc("c_acctbal"), "c_custkey"], 5, 3, {"c_mktsegment": ["BUILDING", "none"]})
    want = sorted(c.collect(), key=lambda r: (-r["c_acctbal"], r["c_custkey"]))
    assert got["records"] == want[3:8] and got["total"] == len(want)
    assert got["facets"] == {"c_mktsegment": {"BUILDING": sum(r["c_mktsegment"] == "BUILDING" for r in want), "none": 0}}
    assert search.page_with_total(c.where("false"), ["c_custkey"], 5)["total"] == 0


def test_datastore_search(spark, rows):
    got = search.datastore_search(rows, "id", q="housing", fields=["id", "title"], limit=2)
    want = plain("housing")
    assert got["total"] == len(want) and [r["id"] for r in got["records"]] == sorted(want, key=lambda k: (-want[k], k))[:2]
    assert got["fields"] == [{"id": "id", "type": "bigint"}, {"id": "title", "type": "string"}] and set(got["records"][0]) == {"id", "title"}
    by = search.datastore_search(rows, "id", filters={"place": ["Toronto", "x"]}, sort="place desc, title", limit=10, offset=1)
    assert [r["id"] for r in by["records"]] == [1, 8] and by["total"] == 3
    assert search.datastore_search(rows, "id", filters={"id": 4})["records"] == [{"id": 4, "title": None, "place": None, "term": 0}]
    for bad in ({"sort": "nothing"}, {"sort": "id; drop"}, {"filters": {"z": 1}}, {"fields": ["z"]}):
        with pytest.raises(ValueError):
            search.datastore_search(rows, "id", **bad)
