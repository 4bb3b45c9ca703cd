"""One query for each kind of operator, on the driver's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import matching
from ..operators import relational as rel
from ..streaming import events as ev
from . import tables
from .registry import view


def _raw(t, name: str) -> DataFrame:
    return t.raw(name)


@view("scan_pushdown", "l_orderkey:l l_extendedprice:d l_shipdate:s", "", "SELECT l_orderkey, l_extendedprice, CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01' AND l_shipdate < TIMESTAMP '2000-04-01' AND l_quantity BETWEEN 10 AND 12")
def scan_pushdown(t):
    """Filters and columns reach the Parquet scan."""
    l = _raw(t, "lineitem").where("l_shipdate >= TIMESTAMP '2000-01-01' AND l_shipdate < TIMESTAMP '2000-04-01' AND l_quantity BETWEEN 10 AND 12")  # noqa: E741
    return l.select("l_orderkey", "l_extendedprice", F.to_date("l_shipdate").alias("l_shipdate"))


@view("datastore_page", "c_custkey:l c_name:s c_acctbal:d", "", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 50 OFFSET 20")
def datastore_page(t):
    """Filters, projection, whitelisted sort, offset and limit."""
    c = _raw(t, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_name", "c_acctbal")
    return rel.page(c.orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey"), limit=50, offset=20)


@view("pricing_summary", "l_returnflag:s l_linestatus:s sum_qty:d sum_disc_price:d avg_disc:d count_order:l", "", """
  SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS sum_disc_price, avg(CAST(l_discount AS DECIMAL(18, 4))) AS avg_disc, count(*) AS count_order
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL""")  # fmt: skip
def pricing_summary(t):
    l = _raw(t, "lineitem").where("l_shipdate <= TIMESTAMP '2000-09-02'")  # noqa: E741
    price = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(price).alias("sum_disc_price"), F.avg(F.col("l_discount").cast("decimal(18,4)")).alias("avg_disc"), F.count("*").alias("count_order"))


@view("semi_anti_joins", "c_custkey:l kind:s", "", """
  SELECT c_custkey, 'buyer' AS kind FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 490000)
  UNION ALL SELECT c_custkey, 'idle' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")  # fmt: skip
def semi_anti_joins(t):
    c, o = _raw(t, "customer").select("c_custkey"), _raw(t, "orders")
    big = o.where("o_totalprice > 490000").select(F.col("o_custkey").alias("c_custkey"))
    done = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(big, "c_custkey", "left_semi").withColumn("kind", F.lit("buyer")).unionByName(c.join(done, "c_custkey", "left_anti").withColumn("kind", F.lit("idle")))


@view("set_operations", "key:l op:s", "", """
  WITH a AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_totalprice > 400000)
  SELECT key, 'both' AS op FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT key, 'first only' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")  # fmt: skip
def set_operations(t):
    o = _raw(t, "orders")
    a, b = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key")), o.where("o_totalprice > 400000").select(F.col("o_custkey").alias("key"))
    return a.intersect(b).withColumn("op", F.lit("both")).unionByName(a.subtract(b).withColumn("op", F.lit("first only")))


@view("full_outer_keys", "key:l n_orders:l n_lines:l", "", """
  SELECT coalesce(a.k, b.k) AS key, coalesce(n_orders, 0) AS n_orders, coalesce(n_lines, 0) AS n_lines FROM (SELECT o_custkey % 977 AS k, count(*) AS n_orders FROM orders GROUP BY 1) a
  FULL JOIN (SELECT l_suppkey AS k, count(*) AS n_lines FROM lineitem GROUP BY 1) b ON a.k = b.k""")  # fmt: skip
def full_outer_keys(t):
    a = _raw(t, "orders").groupBy((F.col("o_custkey") % 977).alias("key")).agg(F.count("*").alias("n_orders"))
    b = _raw(t, "lineitem").groupBy(F.col("l_suppkey").alias("key")).agg(F.count("*").alias("n_lines"))
    return a.join(b, "key", "full").fillna(0, ["n_orders", "n_lines"])


@view("latest_per_customer", "o_custkey:l o_orderkey:l o_orderdate:s", "", "SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_customer(t):
    o = _raw(t, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return rel.latest_per_key(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).withColumn("o_orderdate", F.to_date("o_orderdate"))


@view("lag_growth", "year:l n:l prev:l growth:d", "", "SELECT year, n, lag(n) OVER (ORDER BY year) AS prev, 100.0 * (n - lag(n) OVER (ORDER BY year)) / lag(n) OVER (ORDER BY year) AS growth FROM (SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1)")
def lag_growth(t):
    by_year = _raw(t, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    prev = F.lag("n").over(Window.orderBy("year"))  # a row for each year
    return by_year.withColumn("prev", prev).withColumn("growth", 100.0 * (F.col("n") - F.col("prev")) / F.col("prev"))


@view("rolling_year", "c:l d:s rows_in_window:l sum_in_window:d", "", """
  SELECT a.o_custkey AS c, a.d, count(*) AS rows_in_window, sum(b.v) AS sum_in_window FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.d BETWEEN a.d AND a.d + INTERVAL 12 MONTH GROUP BY ALL""".replace("o a", "(SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, CAST(o_totalprice AS DECIMAL(18, 2)) AS v FROM orders) a").replace("JOIN o b", "JOIN (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, CAST(o_totalprice AS DECIMAL(18, 2)) AS v FROM orders) b"))  # fmt: skip
def rolling_year(t):
    o = _raw(t, "orders").select(F.col("o_custkey").alias("c"), F.to_date("o_orderdate").alias("d"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    return rel.rolling_forward(o, ["c"], "d", "v", 12)


@view("rollup_totals", "segment:s status:s n:l", "", "SELECT coalesce(c_mktsegment, '*ALL*') AS segment, coalesce(o_orderstatus, '*ALL*') AS status, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment, o_orderstatus)")
def rollup_totals(t):
    o = _raw(t, "orders").join(_raw(t, "customer"), F.col("o_custkey") == F.col("c_custkey")).rollup("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"))
    return o.select(F.coalesce("c_mktsegment", F.lit("*ALL*")).alias("segment"), F.coalesce("o_orderstatus", F.lit("*ALL*")).alias("status"), "n")


@view("string_lists", "n_regionkey:l names:s first_six:a", "", "SELECT n_regionkey, string_agg(DISTINCT n_name, '; ' ORDER BY n_name) AS names, list_slice(list(n_name ORDER BY n_nationkey DESC), 1, 6) AS first_six FROM nation GROUP BY 1")
def string_lists(t):
    names = F.array_join(F.array_sort(F.collect_set("n_name")), "; ")
    six = F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n_nationkey")).alias("k"), "n_name"))), lambda x: x["n_name"]), 1, 6)
    return _raw(t, "nation").groupBy("n_regionkey").agg(names.alias("names"), six.alias("first_six"))


@view("json_fields", "event_type:s n:l sum_k:l max_k:l", "", "SELECT event_type, count(*) AS n, sum(CAST(props ->> '$.k' AS BIGINT)) AS sum_k, max(CAST(props ->> '$.k' AS BIGINT)) AS max_k FROM events GROUP BY 1")
def json_fields(t):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return _raw(t, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("sum_k"), F.max(k).alias("max_k"))


@view("event_windows", "window_start:s event_type:s n:l total:d", "", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def event_windows(t):
    return ev.windowed(_raw(t, "events"))


@view("event_sessions", "user_id:l session_start:s n:l", "", """
  SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM (
    SELECT *, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, s""")  # fmt: skip
def event_sessions(t):
    return ev.sessions(_raw(t, "events")).withColumn("session_start", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss"))


@view("cosine_search", "vec_id:l label:l similarity:d", "", """
  SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST([CASE WHEN i % 2 = 0 THEN 1.0 ELSE -0.5 END FOR i IN range(64)] AS DOUBLE[])), 4) AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 10""")  # fmt: skip
def cosine_search(t):
    return matching.cosine_top_k(_raw(t, "embeddings"), [1.0 if i % 2 == 0 else -0.5 for i in range(64)], 10)


@view("nearest_in_block", "left_id:l right_id:l similarity:d", "", """
  SELECT left_id, right_id, similarity FROM (SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 12) AS similarity
    FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE similarity >= 0.2 QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY similarity DESC, right_id) = 1""")  # fmt: skip
def nearest_in_block(t):
    """All rows of a block are candidates for all its other rows."""
    e = _raw(t, "embeddings").select("vec_id", "embedding", F.col("label").alias("block"))
    return matching.nearest_by_blocks(e.withColumnRenamed("vec_id", "left_id"), e.withColumnRenamed("vec_id", "right_id"), 0.2, apart=True)


@view("table_profile", "field:s type:s role:s rows:l non_null:l distinct_values:l", "", """
  SELECT * FROM (VALUES ('c_custkey', 'number', 'identifier', (SELECT count(DISTINCT c_custkey) FROM customer)), ('c_name', 'string', 'identifier', (SELECT count(DISTINCT c_name) FROM customer)), ('c_nationkey', 'number', 'identifier', (SELECT count(DISTINCT c_nationkey) FROM customer)),
    ('c_acctbal', 'number', 'measure', (SELECT count(DISTINCT c_acctbal) FROM customer)), ('c_mktsegment', 'string', 'category', (SELECT count(DISTINCT c_mktsegment) FROM customer))) v(field, type, role, distinct_values), (SELECT count(*) AS rows, count(*) AS non_null FROM customer)""")  # fmt: skip
def table_profile(t):
    return tables.profile(_raw(t, "customer")).withColumnsRenamed({"column": "field", "distinct": "distinct_values"})


@view("chart_data", "x:s value:d", "", "SELECT c_mktsegment AS x, avg(CAST(c_acctbal AS DECIMAL(18, 2))) AS value FROM customer GROUP BY 1 ORDER BY value DESC, x LIMIT 10")
def chart_data(t):
    return tables.chart(_raw(t, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,2)")), "c_mktsegment", "c_acctbal", how="avg", limit=10, by_value=True)


@view("top_and_other", "o_orderstatus:s clerk:s v:d", "", """
  WITH o AS (SELECT o_orderstatus, 'c' || CAST(o_custkey % 37 AS VARCHAR) AS clerk, CAST(o_totalprice AS DECIMAL(18, 2)) AS v FROM orders), top AS (SELECT clerk FROM o GROUP BY 1 ORDER BY sum(v) DESC, clerk LIMIT 7)
  SELECT o_orderstatus, CASE WHEN clerk IN (SELECT clerk FROM top) THEN clerk ELSE 'Other' END AS clerk, sum(v) AS v FROM o GROUP BY 1, 2""")  # fmt: skip
def top_and_other(t):
    o = _raw(t, "orders").select("o_orderstatus", F.concat(F.lit("c"), (F.col("o_custkey") % 37).cast("string")).alias("clerk"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    return tables.top_and_other(o, "clerk", "v", 8, ["o_orderstatus"])


@view("pivoted", "c_mktsegment:s F:d O:d P:d", "", 'SELECT c_mktsegment, sum(CASE WHEN o_orderstatus = \'F\' THEN v END) AS "F", sum(CASE WHEN o_orderstatus = \'O\' THEN v END) AS "O", sum(CASE WHEN o_orderstatus = \'P\' THEN v END) AS "P" FROM (SELECT *, CAST(o_totalprice AS DECIMAL(18, 2)) AS v FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1')
def pivoted(t):
    o = _raw(t, "orders").join(_raw(t, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("v", F.col("o_totalprice").cast("decimal(18,2)"))
    return tables.pivot(o, "c_mktsegment", "o_orderstatus", "v", ["F", "O", "P"])


@view("upserted", "k:l v:s", "", "SELECT k, coalesce(max(v) FILTER (src = 1), max(v) FILTER (src = 0)) AS v FROM (SELECT c_custkey AS k, c_name AS v, 0 AS src FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT c_custkey, upper(c_name), 1 FROM customer WHERE c_acctbal > 0 OR c_mktsegment = 'BUILDING') GROUP BY k")
def upserted(t):
    c = _raw(t, "customer")
    return rel.upsert(c.where("c_mktsegment <> 'BUILDING'").selectExpr("c_custkey k", "c_name v"), c.where("c_acctbal > 0 OR c_mktsegment = 'BUILDING'").selectExpr("c_custkey k", "upper(c_name) v"), ["k"])


@view("inserted_where_new", "k:l", "", "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'")
def inserted_where_new(t):
    c = _raw(t, "customer")
    here, come = c.where("c_mktsegment <> 'BUILDING'").selectExpr("c_custkey k"), c.where("c_acctbal > 0").selectExpr("c_custkey k")
    return rel.anti_insert(here, come.unionAll(come), ["k"])


@view("kept_greatest", "k:l day:s", "", "SELECT o_custkey AS k, CAST(max(o_orderdate) AS DATE) AS day FROM orders GROUP BY 1")
def kept_greatest(t):
    """The latest day of each key, from chunks that are put in one after the other."""
    o = _raw(t, "orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    first = rel.upsert_greatest(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), ["k"], "day")
    return rel.upsert_greatest(first, o.where("o_orderstatus = 'P'"), ["k"], "day")


@view("updated_where_distinct", "k:l day:s changed:b", "", """
  WITH a AS (SELECT c_custkey AS k, max(CAST(o_orderdate AS DATE)) FILTER (o_orderstatus = 'F') AS day FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
  b AS (SELECT o_custkey AS k, max(CAST(o_orderdate AS DATE)) AS day FROM orders WHERE o_totalprice > 50000 GROUP BY 1)
  SELECT a.k, CASE WHEN b.k IS NOT NULL THEN b.day ELSE a.day END AS day, b.k IS NOT NULL AND a.day IS DISTINCT FROM b.day AS changed FROM a LEFT JOIN b ON a.k = b.k""")  # fmt: skip
def updated_where_distinct(t):
    """Stored days, null where there was none, after an update from staged ones that touches only what differs."""
    o = _raw(t, "orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("day"), "o_orderstatus", "o_totalprice")
    had = o.groupBy("k").agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("day"))).alias("day"))
    target = _raw(t, "customer").select(F.col("c_custkey").alias("k")).join(had, "k", "left")
    staged = o.where("o_totalprice > 50000").groupBy("k").agg(F.max("day").alias("day"))
    return rel.update_where_distinct(target, staged, "k", "day").withColumnRenamed("_changed", "changed")


_PAIRED = "o_custkey, o_orderpriority, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status"


@view("paired_backfill", "id:l value:d day:s", "", f"""
  WITH t AS (SELECT o_orderkey AS id, {_PAIRED}, row_number() OVER (PARTITION BY o_custkey, o_orderpriority, status ORDER BY o_orderkey) AS rn FROM orders),
  s AS (SELECT {_PAIRED}, o_totalprice AS value, CAST(o_orderdate AS DATE) AS day, row_number() OVER (PARTITION BY o_custkey, o_orderpriority, status ORDER BY day NULLS LAST, value NULLS LAST) AS rn FROM orders WHERE o_totalprice > 100000)
  SELECT id, value, day FROM t LEFT JOIN s ON t.o_custkey IS NOT DISTINCT FROM s.o_custkey AND t.o_orderpriority IS NOT DISTINCT FROM s.o_orderpriority AND t.status IS NOT DISTINCT FROM s.status AND t.rn = s.rn""")  # fmt: skip
def paired_backfill(t):
    """Missing fields filled from staged rows without ids: the n-th row of a key takes the n-th staged row's."""
    o = _raw(t, "orders").withColumn("status", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    keys_ = ["o_custkey", "o_orderpriority", "status"]
    target = o.select(F.col("o_orderkey").alias("id"), *keys_, F.lit(None).cast("double").alias("value"), F.lit(None).cast("date").alias("day"))
    staged = o.where("o_totalprice > 100000").select(*keys_, F.col("o_totalprice").cast("double").alias("value"), F.to_date("o_orderdate").alias("day"))
    return rel.update_paired(target, staged, keys_, "id", [F.col("day").asc_nulls_last(), F.col("value").asc_nulls_last()], ["value", "day"])


@view("filled_by_mode", "o_orderkey:l fr:s", "", """
  WITH o AS (SELECT o_orderkey, o_orderpriority AS en, CASE WHEN o_orderkey % 3 > 0 THEN 'v' || CAST((o_orderkey * 7) % 4 AS VARCHAR) END AS fr FROM orders),
  m AS (SELECT en, fr FROM (SELECT en, fr, count(*) AS n FROM o WHERE fr IS NOT NULL GROUP BY en, fr) QUALIFY row_number() OVER (PARTITION BY en ORDER BY n DESC, fr) = 1)
  SELECT o_orderkey, coalesce(o.fr, m.fr) AS fr FROM o LEFT JOIN m USING (en)""")  # fmt: skip
def filled_by_mode(t):
    fr = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("v"), (F.col("o_orderkey") * 7 % 4).cast("string")))
    o = _raw(t, "orders").select("o_orderkey", F.col("o_orderpriority").alias("en"), fr.alias("fr"))
    return rel.fill_by_mode(o, "en", "fr")


@view("cleaned_fields", "k:l money:d day:s token:s english:s", "", r"""
  SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(18, 2)) AS money, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS token, substr(o_orderpriority, 3) AS english FROM orders""")  # fmt: skip
def cleaned_fields(t):
    o = _raw(t, "orders")
    raw = o.select(
        F.col("o_orderkey").alias("k"), F.concat(F.lit(" $"), F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)).alias("m"), F.date_format("o_orderdate", "M/d/yyyy").alias("d"),
        F.when(F.col("o_orderstatus") == "P", "None").otherwise(F.col("o_orderstatus")).alias("s"), F.concat(F.expr("substr(o_orderpriority, 3)"), F.lit(" | fr")).alias("e"),
    )
    return raw.select("k", keys.clean_money(F.col("m")).alias("money"), keys.clean_date(F.col("d")).alias("day"), keys.clean_null(F.col("s")).alias("token"), keys.english_half(F.col("e")).alias("english"))
