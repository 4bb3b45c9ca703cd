"""Views over contracts: history, amendments, splitting, growth and concentration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.metrics import bennet, growth_pct, ratio
from ..operators import relational as rel
from .registry import view

COMPETITIVE = ("TC", "TO", "AC", "OB")
FIRST_DAY, LAST_DAY = "2004-01-01", "2026-12-31"
THRESHOLDS = [(25000.0, "~$25K"), (40000.0, "~$40K"), (400000.0, "~$400K")]
_DAYS = f"contract_date BETWEEN DATE '{FIRST_DAY}' AND DATE '{LAST_DAY}'"


def _spent(contracts: DataFrame) -> DataFrame:
    return contracts.where(F.col("effective_value") > 0)


@view("sole_source_count", "n:l", "contracts", "SELECT sum(CASE WHEN solicitation_procedure = 'TN' THEN 1 ELSE 0 END) AS n FROM contracts")
def sole_source_count(t):
    return t["contracts"].where("solicitation_procedure = 'TN'").agg(F.count("*").alias("n"))


def _breakdown(code: str):
    def build(t):
        rows = t["contracts"].where(F.col(code) != "")
        return rows.groupBy(F.col(code).alias("code")).agg(F.count("*").alias("count"), F.coalesce(F.sum("effective_value"), F.lit(0)).alias("total_value"))

    return build


for _name, _code in (("contract_commodity", "commodity_type"), ("contract_solicitation", "solicitation_procedure")):
    view(_name, "code:s count:l total_value:d", "contracts", f"SELECT {_code} AS code, count(*) AS count, sum(effective_value) AS total_value FROM contracts WHERE {_code} <> '' GROUP BY ALL")(_breakdown(_code))


def contract_key():
    """The reference number, or where there is none what else stays the same over a contract's snapshots."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in ("normalized_vendor", "owner_org_title", "original_value")]
    return F.coalesce(F.nullif(F.col("reference_number"), F.lit("")), F.concat(F.lit("CKEY:"), F.concat_ws("|", *parts)))


@view(
    "amendment_creep", "vendor_name:s normalized_vendor:s original_value:d effective_value:d amendment_ratio:d owner_org_title:s contract_date:s amendment_count:l vendor_amendment_total:l", "contracts",
    """SELECT k.*, sum(amendment_count) OVER (PARTITION BY normalized_vendor) AS vendor_amendment_total FROM (
         SELECT max(vendor_name) AS vendor_name, normalized_vendor, original_value, max(effective_value) AS effective_value, max(amendment_ratio) AS amendment_ratio,
                owner_org_title, max(contract_date) AS contract_date, count(CASE WHEN amendment_value > 0 THEN 1 END) AS amendment_count
         FROM contracts WHERE solicitation_procedure = 'TN' GROUP BY reference_number, normalized_vendor, owner_org_title, original_value) k
       QUALIFY vendor_amendment_total >= 2 AND amendment_ratio > 2 AND effective_value > 500000""",
)
def amendment_creep(t, least_value: int = 500_000):
    """Sole-source contracts grown beyond twice over, of vendors with two amendments or more.

    A contract is (reference, vendor, department, original value): references are reused across vendors.
    """
    same = [F.coalesce(F.nullif(F.col("reference_number"), F.lit("")), F.lit("CKEY")).alias("_ref"), "normalized_vendor", "owner_org_title", "original_value"]
    one = t["contracts"].where("solicitation_procedure = 'TN' AND normalized_vendor IS NOT NULL").groupBy(*same).agg(
        F.max("vendor_name").alias("vendor_name"), F.max("effective_value").alias("effective_value"), F.max("amendment_ratio").alias("amendment_ratio"),
        F.max("contract_date").alias("contract_date"), F.count_if(F.col("amendment_value") > 0).alias("amendment_count"),
    )
    # a vendor's contracts that aren't flagged become one row, so that the window has these and the flagged ones only
    flagged = F.when((F.col("amendment_ratio") > 2) & (F.col("effective_value") > least_value), F.struct(*[c for c in one.columns if c != "normalized_vendor"]))
    few = one.groupBy("normalized_vendor", flagged.alias("_f")).agg(F.sum("amendment_count").alias("_n"))
    few = few.withColumn("vendor_amendment_total", F.sum("_n").over(Window.partitionBy("normalized_vendor")))
    return few.where("_f IS NOT NULL AND vendor_amendment_total >= 2").select("normalized_vendor", "_f.*", "vendor_amendment_total").drop("_ref")


_HISTORY = f"""
  SELECT reference_number AS contract_key, max(normalized_vendor) AS normalized_vendor, max(owner_org_title) AS owner_org_title, min(contract_date) AS first_reported,
         max(contract_date) AS last_reported, max(original_value) AS original_value, max(effective_value) AS max_effective_value, count(*) - 1 AS amendment_count,
         arg_min(solicitation_procedure, {{'a': contract_date, 'b': effective_value, 'c': solicitation_procedure}}) AS initial_solicitation_procedure,
         arg_max(solicitation_procedure, {{'a': contract_date, 'b': effective_value, 'c': solicitation_procedure}}) AS final_solicitation_procedure,
         coalesce(array_to_string(list_sort(list(DISTINCT solicitation_procedure)), '→'), '') AS status_transitions
  FROM contracts WHERE {_DAYS} GROUP BY 1"""
_HISTORY_COLUMNS = "contract_key:s normalized_vendor:s owner_org_title:s first_reported:s last_reported:s original_value:d max_effective_value:d amendment_count:l initial_solicitation_procedure:s final_solicitation_procedure:s status_transitions:s"


@view("contract_history", _HISTORY_COLUMNS, "contracts", _HISTORY)
def contract_history(t):
    """A row for each contract over its snapshots, in one aggregation: the least and greatest snapshot need no window.

    status_transitions lists the procedures seen, by code; status_path lists them as they came, repeats dropped.
    """
    rows = t["contracts"].where(_DAYS).withColumn("contract_key", contract_key())
    snapshot = F.struct("contract_date", "effective_value", "solicitation_procedure")
    seen = F.array_sort(F.collect_set("solicitation_procedure"))
    path = F.transform(F.array_sort(F.collect_set(F.struct("contract_date", "solicitation_procedure"))), lambda x: x["solicitation_procedure"])
    out = rows.groupBy("contract_key").agg(
        F.max("normalized_vendor").alias("normalized_vendor"), F.max("owner_org_title").alias("owner_org_title"), F.min(snapshot).alias("_first"), F.max(snapshot).alias("_last"),
        F.max("original_value").alias("original_value"), F.max("effective_value").alias("max_effective_value"), (F.count("*") - 1).alias("amendment_count"),
        F.array_join(seen, "→").alias("status_transitions"), F.array_join(path, "→").alias("status_path"),
    )
    for end, day in (("first", "first_reported"), ("last", "last_reported")):
        procedure = "initial_solicitation_procedure" if end == "first" else "final_solicitation_procedure"
        out = out.withColumns({day: F.col(f"_{end}.contract_date"), procedure: F.col(f"_{end}.solicitation_procedure")}).drop(f"_{end}")
    return out.where("normalized_vendor IS NOT NULL")


@view("competitive_to_sole_source", _HISTORY_COLUMNS, "contracts", f"""
  SELECT * FROM ({_HISTORY}) h WHERE max_effective_value > 100000 AND ((initial_solicitation_procedure <> 'TN' AND final_solicitation_procedure = 'TN')
    OR regexp_matches(status_transitions, '(TC|TO|AC|OB).*TN'))""")  # fmt: skip
def competitive_to_sole_source(t):
    """Contracts above 100,000 that turned from a competitive procedure to sole source, or have seen both."""
    turned = F.col("initial_solicitation_procedure").isin(*COMPETITIVE) & (F.col("final_solicitation_procedure") == "TN")
    both = reduce(lambda a, b: a | b, [F.col("status_transitions").like(f"%{c}%TN%") for c in COMPETITIVE])
    return contract_history(t).where((F.col("max_effective_value") > 100_000) & (turned | both))


@view("threshold_splitting", "normalized_vendor:s owner_org_title:s label:s thr:d window_start:s contracts_in_window:l total_in_window:d", "contracts", f"""
  SELECT normalized_vendor, owner_org_title, label, thr, start AS window_start, n AS contracts_in_window, total AS total_in_window FROM (
    SELECT a.normalized_vendor, a.owner_org_title, a.label, a.thr, a.contract_date AS start, count(*) AS n, sum(b.original_value) AS total FROM near a JOIN near b
      ON a.normalized_vendor = b.normalized_vendor AND a.owner_org_title = b.owner_org_title AND a.label = b.label AND b.contract_date >= a.contract_date AND b.contract_date <= a.contract_date + INTERVAL 12 MONTH
    GROUP BY ALL HAVING count(*) >= 3)
  QUALIFY row_number() OVER (PARTITION BY normalized_vendor, owner_org_title, label ORDER BY n DESC, total DESC, start) = 1""".replace("near a", f"(SELECT c.*, t.* FROM contracts c JOIN (VALUES (25000.0, '~$25K'), (40000.0, '~$40K'), (400000.0, '~$400K')) t(thr, label) ON c.original_value BETWEEN t.thr * 0.8 AND t.thr AND {_DAYS}) a").replace("near b", f"(SELECT c.*, t.* FROM contracts c JOIN (VALUES (25000.0, '~$25K'), (40000.0, '~$40K'), (400000.0, '~$400K')) t(thr, label) ON c.original_value BETWEEN t.thr * 0.8 AND t.thr AND {_DAYS}) b"))  # fmt: skip
def threshold_splitting(t, least: int = 3, months: int = 12):
    """Vendor and department with `least` contracts just below (within a fifth of) a threshold in some year; the fullest.

    Thresholds are an inline list, so a contract's are found in the scan; the year is a RANGE frame.
    """
    marks = F.array(*[F.struct(F.lit(thr).alias("thr"), F.lit(label).alias("label")) for thr, label in THRESHOLDS])
    below = F.filter(marks, lambda m: F.col("original_value").between(m["thr"] * 0.8, m["thr"]))
    any_near = reduce(lambda a, b: a | b, [F.col("original_value").between(thr * 0.8, thr) for thr, _ in THRESHOLDS])
    near = t["contracts"].where(_DAYS).where(any_near).where("owner_org_title IS NOT NULL AND normalized_vendor IS NOT NULL")
    near = near.select("normalized_vendor", "owner_org_title", F.explode(below).alias("m"), "contract_date", "original_value").select("*", "m.thr", "m.label").drop("m")
    w = rel.rolling_forward(near, ["normalized_vendor", "owner_org_title", "label", "thr"], "contract_date", "original_value", months)
    w = w.where(F.col("rows_in_window") >= least).withColumnsRenamed({"contract_date": "window_start", "rows_in_window": "contracts_in_window", "sum_in_window": "total_in_window"})
    order = F.struct((-F.col("contracts_in_window")).alias("a"), (-F.col("total_in_window")).alias("b"), "window_start")
    return rel.first_by(w, ["normalized_vendor", "owner_org_title", "label"], ["thr", "window_start", "contracts_in_window", "total_in_window"], order)


@view("same_vendor_followon", "contract_key:s normalized_vendor:s owner_org_title:s win_date:s competitive_value:d followon_tn_count:l followon_tn_value:d", "contracts", f"""
  SELECT contract_key, h.normalized_vendor, h.owner_org_title, first_reported AS win_date, max_effective_value AS competitive_value, count(*) AS followon_tn_count, sum(c.effective_value) AS followon_tn_value
  FROM ({_HISTORY}) h JOIN contracts c ON c.normalized_vendor = h.normalized_vendor AND c.owner_org_title = h.owner_org_title AND c.solicitation_procedure = 'TN'
    AND c.contract_date > first_reported AND c.contract_date <= first_reported + INTERVAL 24 MONTH
  WHERE initial_solicitation_procedure <> 'TN' AND max_effective_value >= 100000 GROUP BY ALL""")  # fmt: skip
def same_vendor_followon(t, months: int = 24):
    """Sole-source work that a vendor got from a department within two years of a competitive win there.

    Wins are never paired with the work: by vendor, department and day both are summed, and a win's work is the
    difference of two running sums.
    """
    wins = contract_history(t).where(F.col("initial_solicitation_procedure").isin(*COMPETITIVE) & (F.col("max_effective_value") >= 100_000))
    wins = wins.select("contract_key", "normalized_vendor", "owner_org_title", F.col("first_reported").alias("win_date"), F.col("max_effective_value").alias("competitive_value"))
    work = t["contracts"].where("solicitation_procedure = 'TN' AND normalized_vendor IS NOT NULL AND owner_org_title IS NOT NULL AND contract_date IS NOT NULL")
    pair = ["normalized_vendor", "owner_org_title"]
    # wins and work meet by day: one shuffle to vendor and department serves the days, the years after them and the wins
    wins = wins.select(*pair, F.col("win_date").alias("day"), F.struct("contract_key", "competitive_value").alias("_win"), F.lit(0).alias("_n"), F.lit(None).cast(work.schema["effective_value"].dataType).alias("_v"))
    work = work.select(*pair, F.col("contract_date").alias("day"), F.lit(None).cast(wins.schema["_win"].dataType).alias("_win"), F.lit(1).alias("_n"), F.col("effective_value").alias("_v"))
    days = wins.unionByName(work).repartition(*pair).groupBy(*pair, "day").agg(F.collect_list("_win").alias("_wins"), F.sum("_n").alias("_n"), F.sum("_v").alias("_v"))
    upto = lambda c, end: F.expr(f"{c} OVER (PARTITION BY {', '.join(pair)} ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND {end})")
    # what came until the end less what came until the day: running sums, so no day meets the days after it one by one
    later = {k: upto(f, f"INTERVAL {months} MONTH FOLLOWING") - upto(f, "CURRENT ROW") for k, f in (("followon_tn_count", "sum(_n)"), ("_valued", "count(_v)"), ("_value", "sum(coalesce(_v, 0))"))}
    days = days.withColumns(later).where("followon_tn_count > 0 AND size(_wins) > 0").withColumn("followon_tn_value", F.when(F.col("_valued") > 0, F.col("_value")))
    return days.select(*pair, F.col("day").alias("win_date"), "followon_tn_count", "followon_tn_value", F.inline("_wins"))


@view("contract_yearly", "fiscal_year:l code:s contract_count:l total_value:d unique_vendors:l distinct_departments:l", "contracts", f"""
  SELECT year(contract_date) AS fiscal_year, CASE WHEN grouping(commodity_type) = 1 THEN '*ALL*' ELSE commodity_type END AS code, count(*) AS contract_count, sum(effective_value) AS total_value,
         count(DISTINCT normalized_vendor) AS unique_vendors, count(DISTINCT owner_org_title) AS distinct_departments
  FROM contracts WHERE {_DAYS} AND effective_value > 0 GROUP BY GROUPING SETS ((1, commodity_type), (1))""".replace("((1, commodity_type), (1))", "((year(contract_date), commodity_type), (year(contract_date)))"))  # fmt: skip
def contract_yearly(t):
    """Counts, value, vendors and departments by year and category, and by year over all categories."""
    rows = _spent(t["contracts"]).where(_DAYS).withColumn("fiscal_year", F.year("contract_date")).withColumnRenamed("commodity_type", "code")
    # summed once to vendor and department; both groupings and their distinct counts come from that
    fine = rows.groupBy("fiscal_year", "code", "normalized_vendor", "owner_org_title").agg(F.count("*").alias("_n"), F.sum("effective_value").alias("_v"))
    out = fine.rollup("fiscal_year", "code").agg(
        F.grouping_id().alias("_g"), F.sum("_n").alias("contract_count"), F.sum("_v").alias("total_value"), F.count_distinct("normalized_vendor").alias("unique_vendors"), F.count_distinct("owner_org_title").alias("distinct_departments")
    )
    out = out.where("_g = 1 OR _g = 0 AND code <> ''")
    return out.withColumn("code", F.when(F.col("_g") == 1, F.lit("*ALL*")).otherwise(F.col("code"))).drop("_g")


_SHARES = f"""SELECT year(contract_date) AS fiscal_year, commodity_type, normalized_vendor, CAST(sum(effective_value) AS DOUBLE) AS v, count(*) AS n FROM contracts
  WHERE {_DAYS} AND effective_value > 0 AND commodity_type <> '' GROUP BY ALL"""


@view("contract_growth_decomposition", "commodity_type:s fiscal_year:l total_value:d total_prev:d delta_total:d yoy_pct:d volume_component:d unit_cost_component:d hhi:d hhi_prev:d concentration_change:d", "contracts", f"""
  SELECT commodity_type, fiscal_year, t AS total_value, t0 AS total_prev, t - t0 AS delta_total, (t - t0) / nullif(t0, 0) * 100 AS yoy_pct, (q - q0) * (t / q + t0 / q0) / 2 AS volume_component,
         (t / q - t0 / q0) * (q + q0) / 2 AS unit_cost_component, hhi, hhi0 AS hhi_prev, hhi - hhi0 AS concentration_change
  FROM (SELECT *, lag(t) OVER w AS t0, lag(q) OVER w AS q0, lag(hhi) OVER w AS hhi0 FROM (
    SELECT fiscal_year, commodity_type, sum(v) AS t, CAST(sum(n) AS DOUBLE) AS q, sum(p * p) AS hhi FROM (SELECT *, v / sum(v) OVER (PARTITION BY fiscal_year, commodity_type) * 100 AS p FROM ({_SHARES})) GROUP BY ALL)
    WINDOW w AS (PARTITION BY commodity_type ORDER BY fiscal_year)) WHERE q0 IS NOT NULL""")  # fmt: skip
def contract_growth_decomposition(t):
    """Change of spend from year to year by category: Bennet's volume and unit-cost parts, and the change of HHI."""
    rows = _spent(t["contracts"]).where(_DAYS).where((F.col("commodity_type") != "")).withColumn("fiscal_year", F.year("contract_date"))
    by = ["fiscal_year", "commodity_type"]
    shares = rows.groupBy(*by, "normalized_vendor").agg(F.sum("effective_value").alias("_v"), F.count("*").alias("_n"))
    year = shares.groupBy(*by).agg(F.sum("_v").alias("total_value"), F.sum("_n").cast("double").alias("q")).join(rel.hhi(shares, by, "_v"), by)
    year = year.withColumn("total_value", F.col("total_value").cast("double")).withColumn("p", F.col("total_value") / F.col("q"))
    order = Window.partitionBy("commodity_type").orderBy("fiscal_year")  # a row for each category and year
    year = year.withColumns({f"{c}_prev": F.lag(c).over(order) for c in ("total_value", "q", "p", "hhi")}).where("q_prev IS NOT NULL").withColumnRenamed("total_value_prev", "total_prev")
    volume, cost = bennet(F.col("q"), F.col("q_prev"), F.col("p"), F.col("p_prev"))
    return year.withColumns({"delta_total": F.col("total_value") - F.col("total_prev"), "yoy_pct": growth_pct(F.col("total_value"), F.col("total_prev")), "volume_component": volume, "unit_cost_component": cost, "concentration_change": F.col("hhi") - F.col("hhi_prev")})


_BUCKETS = f"""
  SELECT fiscal_year, owner_org_title, commodity_type, sum(n) AS contract_count, sum(v) AS total_value, sum(v) / sum(n) AS avg_value, count(*) AS vendor_count, sum(p * p) AS hhi FROM (
    SELECT *, v / sum(v) OVER (PARTITION BY fiscal_year, owner_org_title, commodity_type) * 100 AS p FROM (
      SELECT year(contract_date) AS fiscal_year, owner_org_title, commodity_type, normalized_vendor, CAST(sum(effective_value) AS DOUBLE) AS v, count(*) AS n FROM contracts
      WHERE {_DAYS} AND effective_value > 0 AND (owner_org_title, commodity_type) IN (SELECT (owner_org_title, commodity_type) FROM (
        SELECT owner_org_title, commodity_type FROM contracts WHERE {_DAYS} AND effective_value > 0 AND owner_org_title <> '' AND commodity_type IN ('S', 'G', 'C') GROUP BY ALL ORDER BY sum(effective_value) DESC, 1, 2 LIMIT 30))
      GROUP BY ALL)) GROUP BY ALL"""
_BUCKET_COLUMNS = "fiscal_year:l owner_org_title:s commodity_type:s contract_count:l total_value:d avg_value:d vendor_count:l hhi:d"


@view("contract_bucket_yearly", _BUCKET_COLUMNS, "contracts", _BUCKETS)
def contract_bucket_yearly(t, buckets: int = 30):
    """By year, the `buckets` pairs of department and category with most spend: count, value, average, vendors, HHI.

    The scan is summed once, to vendors, and these once to years and pairs; HHI comes from the sum of squares. A pair's
    years are kept with it while the top ones are picked, so nothing is made a second time.
    """
    rows = _spent(t["contracts"]).where(_DAYS).where(F.col("commodity_type").isin("S", "G", "C") & (F.col("owner_org_title") != "")).withColumn("fiscal_year", F.year("contract_date"))
    pair, by = ["owner_org_title", "commodity_type"], ["fiscal_year", "owner_org_title", "commodity_type"]
    shares = rows.groupBy(*by, "normalized_vendor").agg(F.sum("effective_value").alias("_v"), F.count("*").alias("_n"))
    square = F.col("_v").cast("double") * F.col("_v").cast("double")
    total = shares.groupBy(*by).agg(F.sum("_n").alias("contract_count"), F.sum("_v").alias("total_value"), F.count("*").alias("vendor_count"), F.sum(square).alias("_q"))
    years = F.collect_list(F.struct("fiscal_year", "contract_count", "total_value", "vendor_count", "_q"))  # as many as there are years
    top = total.groupBy(*pair).agg(F.sum("total_value").alias("_t"), years.alias("_years")).orderBy(F.desc("_t"), *pair).limit(buckets)
    value = F.col("total_value").cast("double")
    out = top.select(*pair, F.inline("_years"))
    return out.withColumns({"hhi": F.col("_q") / (value * value) * 10_000.0, "avg_value": value / F.col("contract_count")}).drop("_q")


@view("contract_yoy_decomposition", _BUCKET_COLUMNS + " total_prev:d count_prev:l avg_prev:d hhi_prev:d delta_total_pct:d delta_count_pct:d delta_avg_pct:d delta_hhi:d", "contracts", f"""
  SELECT *, (total_value - total_prev) / nullif(total_prev, 0) * 100 AS delta_total_pct, (contract_count - count_prev) / nullif(count_prev, 0) * 100 AS delta_count_pct,
         (avg_value - avg_prev) / nullif(avg_prev, 0) * 100 AS delta_avg_pct, hhi - hhi_prev AS delta_hhi
  FROM (SELECT *, lag(total_value) OVER w AS total_prev, lag(contract_count) OVER w AS count_prev, lag(avg_value) OVER w AS avg_prev, lag(hhi) OVER w AS hhi_prev
        FROM ({_BUCKETS}) WINDOW w AS (PARTITION BY owner_org_title, commodity_type ORDER BY fiscal_year))""")  # fmt: skip
def contract_yoy_decomposition(t):
    order = Window.partitionBy("owner_org_title", "commodity_type").orderBy("fiscal_year")
    b = contract_bucket_yearly(t).withColumn("total_value", F.col("total_value").cast("double"))
    b = b.withColumns({"total_prev": F.lag("total_value").over(order), "count_prev": F.lag("contract_count").over(order), "avg_prev": F.lag("avg_value").over(order), "hhi_prev": F.lag("hhi").over(order)})
    grown = {f"delta_{k}_pct": growth_pct(F.col(now), F.col(f"{k}_prev")) for k, now in (("total", "total_value"), ("count", "contract_count"), ("avg", "avg_value"))}
    return b.withColumns(grown | {"delta_hhi": F.col("hhi") - F.col("hhi_prev")})


@view("service_contracts_count", "n:l total_value:d unique_vendors:l", "contracts", "SELECT count(*) AS n, coalesce(sum(effective_value), 0) AS total_value, count(DISTINCT normalized_vendor) AS unique_vendors FROM contracts WHERE commodity_type = 'S' AND effective_value > 0")
def service_contracts_count(t):
    return _spent(t["contracts"]).where("commodity_type = 'S'").agg(F.count("*").alias("n"), F.coalesce(F.sum("effective_value"), F.lit(0)).alias("total_value"), F.count_distinct("normalized_vendor").alias("unique_vendors"))


def _vendor_totals(rows: DataFrame, by: list[str]) -> DataFrame:
    rows = _spent(rows).where("normalized_vendor IS NOT NULL").withColumnRenamed("normalized_vendor", "norm_vendor")
    return rows.groupBy(*by, "norm_vendor").agg(F.max("vendor_name").alias("display_name"), F.sum("effective_value").alias("total_value"), F.count("*").alias("contract_count"))


@view("vendor_concentration", "norm_vendor:s display_name:s total_value:d contract_count:l", "contracts", """
  SELECT normalized_vendor AS norm_vendor, max(vendor_name) AS display_name, sum(effective_value) AS total_value, count(*) AS contract_count FROM contracts
  WHERE commodity_type = 'S' AND effective_value > 0 AND normalized_vendor IS NOT NULL GROUP BY 1 ORDER BY total_value DESC, 1 LIMIT 50""")  # fmt: skip
def vendor_concentration(t):
    return rel.top_k(_vendor_totals(t["contracts"].where("commodity_type = 'S'"), []), [F.desc("total_value"), F.asc("norm_vendor")], 50)


@view("vendor_name_dupes", "strip_key:s distinct_norm:l variant_count:l cluster_spend:d cluster_contracts:l norm_vendors:a sample_names:a", "contracts", rf"""
  SELECT strip_key, count(DISTINCT normalized_vendor) AS distinct_norm, count(*) AS variant_count, sum(spend) AS cluster_spend, sum(n) AS cluster_contracts,
         list_slice(list_sort(list(DISTINCT normalized_vendor)), 1, 6) AS norm_vendors, list_slice(list(vendor_name ORDER BY spend DESC, vendor_name), 1, 6) AS sample_names
  FROM (SELECT normalized_vendor, vendor_name, regexp_replace(regexp_replace(upper(vendor_name), '\s+({'|'.join(keys.STRIP_SUFFIXES)})\.?\s*$', ''), '[^A-Z0-9]', '', 'g') AS strip_key, sum(effective_value) AS spend, count(*) AS n
        FROM contracts WHERE effective_value > 0 AND normalized_vendor IS NOT NULL GROUP BY ALL)
  WHERE length(strip_key) >= 4 GROUP BY strip_key HAVING count(DISTINCT normalized_vendor) > 1 AND sum(spend) > 1000000 ORDER BY cluster_spend DESC, strip_key LIMIT 200""")  # fmt: skip
def vendor_name_dupes(t):
    """Names that the normaliser keeps apart though they differ in spacing and one suffix only."""
    names = _spent(t["contracts"]).where("normalized_vendor IS NOT NULL").groupBy("normalized_vendor", "vendor_name").agg(F.sum("effective_value").alias("spend"), F.count("*").alias("n"))
    names = names.withColumn("strip_key", keys.strip_key(F.col("vendor_name"))).where(F.length("strip_key") >= 4)
    by_spend = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("spend")).alias("s"), F.col("vendor_name").alias("v")))), 1, 6)
    out = names.groupBy("strip_key").agg(
        F.count_distinct("normalized_vendor").alias("distinct_norm"), F.count("*").alias("variant_count"), F.sum("spend").alias("cluster_spend"), F.sum("n").alias("cluster_contracts"),
        F.slice(F.array_sort(F.collect_set("normalized_vendor")), 1, 6).alias("norm_vendors"), by_spend.alias("_top"),
    )
    out = out.where("distinct_norm > 1 AND cluster_spend > 1000000")
    out = out.withColumns({"sample_names": F.transform("_top", lambda x: x["v"]), "sample_spend": F.transform("_top", lambda x: -x["s"])}).drop("_top")
    return rel.top_k(out, [F.desc("cluster_spend"), F.asc("strip_key")], 200)


_CONCENTRATION_COLUMNS = "segment:s norm_vendor:s display_name:s total_value:d contract_count:l share_pct:d rnk:l seg_total_value:d seg_contract_count:l seg_vendor_count:l hhi:d cr4:d cr10:d"


def _concentration_sql(segment: str, where: str) -> str:
    ranked = f"""(SELECT *, row_number() OVER (PARTITION BY segment ORDER BY total_value DESC, norm_vendor) AS rnk, CAST(total_value AS DOUBLE) / CAST(sum(total_value) OVER s AS DOUBLE) * 100 AS share_pct,
      sum(total_value) OVER s AS seg_total_value, sum(contract_count) OVER s AS seg_contract_count, count(*) OVER s AS seg_vendor_count
      FROM (SELECT {segment} AS segment, normalized_vendor AS norm_vendor, max(vendor_name) AS display_name, sum(effective_value) AS total_value, count(*) AS contract_count
            FROM contracts WHERE {where} AND {segment} <> '' AND effective_value > 0 AND normalized_vendor IS NOT NULL GROUP BY ALL) WINDOW s AS (PARTITION BY segment))"""
    return f"""SELECT segment, norm_vendor, display_name, total_value, contract_count, share_pct, rnk, seg_total_value, seg_contract_count, seg_vendor_count, NULL AS hhi, NULL AS cr4, NULL AS cr10 FROM {ranked} r WHERE rnk <= 20
    UNION ALL SELECT segment, '*SEGMENT*', NULL, any_value(seg_total_value), any_value(seg_contract_count), NULL, 0, any_value(seg_total_value), any_value(seg_contract_count), any_value(seg_vendor_count),
      sum(share_pct * share_pct), sum(CASE WHEN rnk <= 4 THEN share_pct ELSE 0 END), sum(CASE WHEN rnk <= 10 THEN share_pct ELSE 0 END) FROM {ranked} r GROUP BY segment"""


@view("vendor_concentration_by_category", _CONCENTRATION_COLUMNS, "contracts", _concentration_sql("commodity_type", "TRUE"))
def vendor_concentration_by_category(t):
    """Top 20 vendors of each category, and each category's HHI, CR4 and CR10 over all its vendors."""
    rows = t["contracts"].where("commodity_type <> ''").withColumnRenamed("commodity_type", "segment")
    return rel.concentration(_vendor_totals(rows, ["segment"]), "segment", "norm_vendor", "total_value", "contract_count")


@view("vendor_concentration_by_department", _CONCENTRATION_COLUMNS, "contracts", _concentration_sql("owner_org_title", "commodity_type = 'S'"))
def vendor_concentration_by_department(t):
    rows = t["contracts"].where("commodity_type = 'S' AND owner_org_title <> ''").withColumnRenamed("owner_org_title", "segment")
    return rel.concentration(_vendor_totals(rows, ["segment"]), "segment", "norm_vendor", "total_value", "contract_count")


def search(contracts: DataFrame, vendor: str | None = None, department: str | None = None, procedure: str | None = None, least_value: float | None = None, sort: str = "value", limit: int = 25) -> DataFrame:
    """Contracts that fulfil all stated conditions, the largest by value, amendment ratio or date; 100 at most."""
    conditions = [
        None if vendor is None else F.contains(F.lower("vendor_name"), F.lit(vendor.lower())), None if department is None else F.contains(F.lower("owner_org_title"), F.lit(department.lower())),
        None if procedure is None else F.col("solicitation_procedure") == procedure, None if least_value is None else F.col("effective_value") >= least_value,
    ]
    for c in conditions:
        contracts = contracts if c is None else contracts.where(c)
    by = {"value": "effective_value", "amendment_ratio": "amendment_ratio", "date": "contract_date"}
    return contracts.orderBy(F.col(by.get(sort, "effective_value")).desc_nulls_last(), "reference_number", "vendor_name", "original_value").limit(max(1, min(limit, 100)))


@view("search_contracts", "vendor_name:s owner_org_title:s effective_value:d amendment_ratio:d contract_date:s reference_number:s", "contracts", """
  SELECT * FROM contracts WHERE contains(lower(vendor_name), 'deloitte') AND solicitation_procedure = 'TN' ORDER BY effective_value DESC NULLS LAST, reference_number, vendor_name, original_value LIMIT 50""")  # fmt: skip
def search_contracts(t):
    return search(t["contracts"], vendor="Deloitte", procedure="TN", limit=50)


@view("contract_search_summary", "n:l first_date:s last_date:s total_value:d n_sole_source:l n_amended:l max_ratio:d", "contracts", """
  SELECT count(*) AS n, min(contract_date) AS first_date, max(contract_date) AS last_date, sum(effective_value) AS total_value, count(*) FILTER (solicitation_procedure = 'TN') AS n_sole_source,
         count(*) FILTER (amendment_value > 0) AS n_amended, max(amendment_ratio) AS max_ratio FROM contracts WHERE contains(lower(vendor_name), 'kpmg')""")  # fmt: skip
def contract_search_summary(t):
    hits = t["contracts"].where(F.contains(F.lower("vendor_name"), F.lit("kpmg")))
    return hits.agg(F.count("*").alias("n"), F.min("contract_date").alias("first_date"), F.max("contract_date").alias("last_date"), F.sum("effective_value").alias("total_value"), F.count_if(F.col("solicitation_procedure") == "TN").alias("n_sole_source"), F.count_if(F.col("amendment_value") > 0).alias("n_amended"), F.max("amendment_ratio").alias("max_ratio"))


@view("quarterly_snapshots", "normalized_vendor:s original_value:d snapshots:l", "contracts", "SELECT normalized_vendor, original_value, count(*) AS snapshots FROM contracts GROUP BY ALL HAVING count(*) >= 3")
def quarterly_snapshots(t):
    """Vendor and original value that recur three times or more: snapshots of one contract rather than contracts."""
    return t["contracts"].groupBy("normalized_vendor", "original_value").agg(F.count("*").alias("snapshots")).where("snapshots >= 3")


@view("market_shares", "top5_pct:d top10_pct:d sole_source_pct:d", "contracts", """
  SELECT 100.0 * sum(v) FILTER (r <= 5) / sum(v) AS top5_pct, 100.0 * sum(v) FILTER (r <= 10) / sum(v) AS top10_pct, (SELECT 100.0 * count(*) FILTER (solicitation_procedure = 'TN') / count(*) FROM contracts) AS sole_source_pct
  FROM (SELECT CAST(sum(effective_value) AS DOUBLE) AS v, row_number() OVER (ORDER BY sum(effective_value) DESC, normalized_vendor) AS r FROM contracts WHERE commodity_type = 'S' AND effective_value > 0 AND normalized_vendor IS NOT NULL GROUP BY normalized_vendor)""")  # fmt: skip
def market_shares(t):
    """Shares of the service market's 5 and 10 largest vendors, and of sole source among all contracts; each part
    comes from a top-k, not from a sort of all vendors."""
    totals = _vendor_totals(t["contracts"].where("commodity_type = 'S'"), [])
    top = rel.top_k(totals, [F.desc("total_value"), F.asc("norm_vendor")], 10).withColumn("_r", F.row_number().over(Window.orderBy(F.desc("total_value"), "norm_vendor")))
    part = top.agg(F.sum(F.when(F.col("_r") <= 5, F.col("total_value"))).cast("double").alias("_5"), F.sum("total_value").cast("double").alias("_10"))
    whole = totals.agg(F.sum("total_value").cast("double").alias("_all"))
    sole = t["contracts"].agg((F.count_if(F.col("solicitation_procedure") == "TN") * 100.0 / F.count("*")).alias("sole_source_pct"))
    one = part.crossJoin(whole).crossJoin(sole)  # a row each
    return one.select((ratio(F.col("_5"), F.col("_all")) * 100).alias("top5_pct"), (ratio(F.col("_10"), F.col("_all")) * 100).alias("top10_pct"), "sole_source_pct")
