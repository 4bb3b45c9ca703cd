"""Views over recipients' filings: dependency, cessation, capacity; and canonical charity metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import bn_prefix
from ..functions.metrics import annualized, cap_pct, ratio
from ..operators.relational import first_by
from .network import AS_OF, names_by_prefix
from .registry import view

# Words in the names of public bodies, which are no charities in the sense of these views.
PUBLIC = [
    "%gouvernement%", "%government of%", "province of %", "%ministry of%", "%ministère%", "%department of%", "%sa majesté%", "%his majesty%", "%her majesty%", "%university%", "%université%", "%college%", "%collège%",
    "%municipality of%", "%city of %", "%ville de %", "%health authority%", "%régie de la santé%", "%regional health%", "%crown corporation%",
]
# Fixed values.
ZOMBIE_ONLY = ["%provincial government%", "%agence de la santé%"]
# Fixed values.
GHOST_ONLY = ["%trust%", "%estate of%", "%succession de%", "%testamentary%", "%regional integrated health%", "%health centre of%", "%centre de santé%", "%library service board%", "%community services agency%"]


def _is_public(name, patterns):
    return reduce(lambda a, b: a | b, [F.coalesce(name, F.lit("")).ilike(p) for p in patterns])


def _public_sql(name: str, patterns) -> str:
    return " OR ".join(f"coalesce({name}, '') ILIKE '{p}'" for p in patterns)


def _granted(grants: DataFrame, since: str) -> DataFrame:
    g = grants.where((F.length("recipient_business_number") >= 9) & (F.col("agreement_value") > 0) & (F.col("agreement_start_date") >= F.lit(since).cast("date")))
    return g.groupBy(bn_prefix(F.col("recipient_business_number")).alias("bn")).agg(
        F.max("recipient_legal_name").alias("grant_name"), F.sum("agreement_value").alias("total_grants"), F.count("*").alias("grant_count"),
        F.greatest(F.count_distinct(F.year("agreement_start_date")), F.lit(1)).alias("years_active"), F.max("agreement_start_date").alias("last_grant_date"),
    )


def _latest_filing(financial: DataFrame, columns: list[str]) -> DataFrame:
    f = financial.where("fpe IS NOT NULL").withColumn("_p", bn_prefix(F.col("bn"))).drop("bn")
    return first_by(f, ["_p"], [*columns, "fpe"], F.struct(-F.datediff("fpe", F.lit("1970-01-01")), *columns)).withColumnRenamed("_p", "bn")


_G = "SELECT substr(recipient_business_number, 1, 9) AS bn, max(recipient_legal_name) AS grant_name, sum(agreement_value) AS total_grants, count(*) AS grant_count, greatest(count(DISTINCT year(agreement_start_date)), 1) AS years_active, max(agreement_start_date) AS last_grant_date FROM grants WHERE length(recipient_business_number) >= 9 AND agreement_value > 0 AND agreement_start_date >= DATE '{}' GROUP BY 1"
_F = "SELECT substr(bn, 1, 9) AS bn, total_revenue, fpe FROM financial WHERE fpe IS NOT NULL QUALIFY row_number() OVER (PARTITION BY substr(bn, 1, 9) ORDER BY fpe DESC, total_revenue) = 1"


@view("zombie_recipients", "bn:s legal_name:s total_revenue:d gov_funding:d gov_pct:d grant_count:l years_active:l total_grants:d grants_3yr_pre_fpe:d last_fpe:s fpe_age_months:d last_grant_date:s last_list_year:l cohort:s", "grants financial charities charity_history", f"""
  WITH g AS ({_G.format('2017-01-01')}), f AS ({_F}), i AS (SELECT substr(bn, 1, 9) AS bn, min(legal_name) AS nm FROM charities GROUP BY 1),
  h AS (SELECT substr(bn, 1, 9) AS bn, max(list_year) AS last_list_year, arg_max(legal_name, list_year) AS nm FROM charity_history GROUP BY 1),
  b AS (SELECT f.bn, sum(agreement_value) AS v FROM grants JOIN f ON substr(recipient_business_number, 1, 9) = f.bn WHERE agreement_value > 0 AND agreement_start_date BETWEEN fpe - INTERVAL 3 YEAR AND fpe GROUP BY 1),
  j AS (SELECT g.*, coalesce(i.nm, h.nm, grant_name) AS legal_name, total_revenue, fpe AS last_fpe, last_list_year, CAST(total_grants AS DOUBLE) / years_active AS gov_funding, coalesce(b.v, 0) AS grants_3yr_pre_fpe,
          least(CAST(total_grants AS DOUBLE) / years_active / nullif(CAST(total_revenue AS DOUBLE), 0) * 100, 100) AS gov_pct, (DATE '{AS_OF}' - fpe) / 30.44 AS fpe_age_months
        FROM g LEFT JOIN f USING (bn) LEFT JOIN i USING (bn) LEFT JOIN h USING (bn) LEFT JOIN b USING (bn)
        WHERE bn NOT IN (SELECT substr(recipient_business_number, 1, 9) FROM grants WHERE recipient_type = 'G' AND recipient_business_number IS NOT NULL))
  SELECT *, CASE WHEN last_list_year < 2024 THEN 'cessation' ELSE 'dependency_risk' END AS cohort FROM j WHERE NOT ({_public_sql('legal_name', PUBLIC + ZOMBIE_ONLY)})
    AND ((last_list_year < 2024 AND grants_3yr_pre_fpe >= 1000000 AND year(last_grant_date) <= last_list_year + 1) OR (coalesce(last_list_year, 2024) = 2024 AND total_revenue > 500000 AND gov_pct >= 70))""")  # fmt: skip
def zombie_recipients(t, since: str = "2017-01-01", latest_list: int = 2024, as_of: str = AS_OF):
    """Two cohorts of grant recipients: those gone from the charity list after a million or more in the three years
    before their last filing, and those still listed whose yearly grants are 70 % of revenue or more."""
    g = _granted(t["grants"], since)
    filing = _latest_filing(t["financial"], ["total_revenue"])
    history = t["charity_history"].groupBy(bn_prefix(F.col("bn")).alias("bn")).agg(F.max("list_year").alias("last_list_year"), F.max_by("legal_name", "list_year").alias("_h"))
    names = names_by_prefix(t["charities"]).withColumnsRenamed({"bn_prefix": "bn", "legal_name": "_i"})
    paid = t["grants"].where("agreement_value > 0").select(bn_prefix(F.col("recipient_business_number")).alias("bn"), "agreement_value", "agreement_start_date")
    before = paid.join(filing.select("bn", "fpe"), "bn").where(F.col("agreement_start_date").between(F.add_months("fpe", -36), F.col("fpe"))).groupBy("bn").agg(F.sum("agreement_value").alias("_b"))
    public = t["grants"].where("recipient_type = 'G'").select(bn_prefix(F.col("recipient_business_number")).alias("bn")).where("bn IS NOT NULL").distinct()
    j = g.join(public, "bn", "left_anti").join(filing, "bn", "left").join(names, "bn", "left").join(history, "bn", "left").join(before, "bn", "left")
    funding = annualized(F.col("total_grants").cast("double"), F.col("years_active"))
    j = j.withColumns({
        "legal_name": F.coalesce("_i", "_h", "grant_name"), "gov_funding": funding, "grants_3yr_pre_fpe": F.coalesce("_b", F.lit(0)),
        "gov_pct": F.least(ratio(funding, F.col("total_revenue").cast("double")) * 100, F.lit(100.0)), "fpe_age_months": F.date_diff(F.lit(as_of).cast("date"), F.col("fpe")) / 30.44,
    }).withColumnRenamed("fpe", "last_fpe")
    j = j.where(~_is_public(F.col("legal_name"), PUBLIC + ZOMBIE_ONLY))
    quiet = F.col("last_grant_date").isNull() | (F.year("last_grant_date") <= F.col("last_list_year") + 1)
    ceased = (F.col("last_list_year") < latest_list) & (F.col("grants_3yr_pre_fpe") >= 1_000_000) & quiet
    depends = (F.coalesce("last_list_year", F.lit(latest_list)) == latest_list) & (F.col("total_revenue") > 500_000) & (F.col("gov_pct") >= 70)
    return j.withColumn("cohort", F.when(ceased, "cessation").when(depends, "dependency_risk")).where("cohort IS NOT NULL")


_GHOST_SIGNALS = ["sig_no_employees", "sig_no_programs", "sig_no_address", "sig_comp_heavy", "sig_pass_through", "sig_no_non_gov_rev"]


@view("ghost_capacity", "bn:s legal_name:s designation:s total_revenue:d total_expenditure:d compensation_total:d employee_count:l verified_grants_annual:d transfers_out_total:d fpe:s comp_pct:d comp_pct_raw:d gov_pct:d transfer_out_pct:d non_gov_revenue:d "
      + " ".join(f"{s}:b" for s in _GHOST_SIGNALS) + " ghost_score:l", "financial compensation programs charities charity_history grants transfers", f"""
  WITH f AS (SELECT substr(bn, 1, 9) AS k, * FROM financial WHERE total_revenue > 0 AND fpe IS NOT NULL QUALIFY row_number() OVER (PARTITION BY substr(bn, 1, 9) ORDER BY fpe DESC, total_revenue) = 1),
  e AS (SELECT substr(bn, 1, 9) AS k, max(CASE WHEN n <= 500000 THEN n END) AS employees FROM (SELECT bn, coalesce(ft_employees, 0) + coalesce(pt_employees, 0) AS n FROM compensation) GROUP BY 1),
  p AS (SELECT substr(bn, 1, 9) AS k, bool_or(length(trim(description)) > 10) AS described FROM programs GROUP BY 1),
  i AS (SELECT substr(bn, 1, 9) AS k, any_value(legal_name) AS nm, any_value(designation) AS ds, bool_or(address <> '' AND city <> '') AS placed FROM charities GROUP BY 1),
  h AS (SELECT substr(bn, 1, 9) AS k, arg_max(legal_name, list_year) AS nm, arg_max(designation, list_year) AS ds FROM charity_history GROUP BY 1),
  gn AS (SELECT substr(recipient_business_number, 1, 9) AS k, max(recipient_legal_name) AS nm FROM grants WHERE length(recipient_business_number) >= 9 GROUP BY 1),
  g AS ({_G.format('2020-01-01')}), o AS (SELECT substr(donor_bn, 1, 9) AS k, sum(total_gifts) AS v FROM transfers GROUP BY 1),
  x AS (SELECT f.k AS bn, coalesce(i.nm, h.nm, gn.nm) AS legal_name, coalesce(i.ds, h.ds) AS designation, total_revenue, total_expenditure, CAST(gov_funding_federal AS DOUBLE) AS gov, CAST(gov_funding_provincial AS DOUBLE) AS inv, fpe, employees AS employee_count,
          coalesce(compensation, mgmt_admin_exp, 0) AS compensation_total, coalesce(CAST(total_grants AS DOUBLE) / years_active, 0) AS verified_grants_annual, coalesce(o.v, 0) AS transfers_out_total,
          CAST(coalesce(compensation, mgmt_admin_exp, 0) AS DOUBLE) / CAST(total_revenue AS DOUBLE) AS c, CAST(coalesce(o.v, 0) AS DOUBLE) / nullif(CAST(total_expenditure AS DOUBLE), 0) AS r, coalesce(described, FALSE) AS described, coalesce(placed, FALSE) AS placed
        FROM f LEFT JOIN e USING (k) LEFT JOIN p USING (k) LEFT JOIN i USING (k) LEFT JOIN h USING (k) LEFT JOIN gn USING (k) LEFT JOIN g ON g.bn = f.k LEFT JOIN o USING (k)),
  s AS (SELECT *, CAST(total_revenue AS DOUBLE) - gov - verified_grants_annual AS non_gov_revenue, employee_count IS NULL OR employee_count <= 1 AS sig_no_employees, NOT described AS sig_no_programs, NOT placed AS sig_no_address, c >= 0.6 AS sig_comp_heavy, r >= 0.6 AS sig_pass_through FROM x),
  z AS (SELECT *, non_gov_revenue <= 0 AS sig_no_non_gov_rev FROM s)
  SELECT *, least(c * 100, 100) AS comp_pct, c * 100 AS comp_pct_raw, least((gov + verified_grants_annual) / CAST(total_revenue AS DOUBLE) * 100, 100) AS gov_pct, coalesce(r, 0) * 100 AS transfer_out_pct,
         {' + '.join(f'CAST({s} AS INT)' for s in _GHOST_SIGNALS)} AS ghost_score
  FROM z WHERE total_revenue > 100000 AND {' + '.join(f'CAST({s} AS INT)' for s in _GHOST_SIGNALS)} >= 3 AND NOT (coalesce(designation, '') IN ('A', 'B') AND inv / CAST(total_revenue AS DOUBLE) >= 0.3)
    AND NOT ({_public_sql('legal_name', PUBLIC + GHOST_ONLY)}) AND compensation_total <= total_revenue * 2""")  # fmt: skip
def ghost_capacity(t, since: str = "2020-01-01"):
    """Filers with three or more of six signs of little capacity. A sign that cannot be told (nothing spent) drops
    the row, as a null sum does; investment vehicles, trusts and public bodies are left out."""
    key = bn_prefix(F.col("bn"))
    money = ["total_expenditure", "gov_funding_federal", "gov_funding_provincial", "compensation", "mgmt_admin_exp"]
    f = _latest_filing(t["financial"].where("total_revenue > 0"), ["total_revenue", *money])
    staff = (F.coalesce("ft_employees", F.lit(0)) + F.coalesce("pt_employees", F.lit(0))).alias("n")
    e = t["compensation"].select(key.alias("bn"), staff).groupBy("bn").agg(F.max(F.when(F.col("n") <= 500_000, F.col("n"))).alias("employee_count"))
    p = t["programs"].groupBy(key.alias("bn")).agg(F.bool_or(F.length(F.trim("description")) > 10).alias("_described"))
    listed = t["charities"].groupBy(key.alias("bn")).agg(F.min_by(F.struct("legal_name", "designation"), "legal_name").alias("_i"), F.bool_or((F.coalesce("address", F.lit("")) != "") & (F.coalesce("city", F.lit("")) != "")).alias("_placed"))
    past = t["charity_history"].where("legal_name IS NOT NULL").groupBy(key.alias("bn")).agg(F.max_by(F.struct("legal_name", "designation"), "list_year").alias("_h"))
    funded = t["grants"].where(F.length("recipient_business_number") >= 9).groupBy(bn_prefix(F.col("recipient_business_number")).alias("bn")).agg(F.max("recipient_legal_name").alias("_g"))
    who = listed.join(past, "bn", "full").join(funded, "bn", "full").select("bn", F.coalesce("_i.legal_name", "_h.legal_name", "_g").alias("legal_name"), F.coalesce("_i.designation", "_h.designation").alias("designation"), "_placed")
    out = t["transfers"].where("donor_bn IS NOT NULL").groupBy(bn_prefix(F.col("donor_bn")).alias("bn")).agg(F.sum(F.coalesce("total_gifts", F.lit(0))).alias("_out"))
    x = f.join(e, "bn", "left").join(p, "bn", "left").join(who, "bn", "left").join(_granted(t["grants"], since).drop("grant_name"), "bn", "left").join(out, "bn", "left")
    num = lambda c: F.col(c).cast("double")
    x = x.withColumns({
        "compensation_total": F.coalesce("compensation", "mgmt_admin_exp", F.lit(0)), "transfers_out_total": F.coalesce("_out", F.lit(0)),
        "verified_grants_annual": F.coalesce(annualized(num("total_grants"), F.col("years_active")), F.lit(0.0)),
    })
    gov = F.coalesce(num("gov_funding_federal"), F.lit(0.0))
    x = x.withColumns({"_c": ratio(num("compensation_total"), num("total_revenue")), "_r": ratio(num("transfers_out_total"), num("total_expenditure")), "non_gov_revenue": num("total_revenue") - gov - F.col("verified_grants_annual")})
    x = x.withColumns({
        "sig_no_employees": F.col("employee_count").isNull() | (F.col("employee_count") <= 1), "sig_no_programs": ~F.coalesce("_described", F.lit(False)), "sig_no_address": ~F.coalesce("_placed", F.lit(False)),
        "sig_comp_heavy": F.col("_c") >= 0.6, "sig_pass_through": F.col("_r") >= 0.6, "sig_no_non_gov_rev": F.col("non_gov_revenue") <= 0,
        "comp_pct": cap_pct(F.coalesce("_c", F.lit(0.0)) * 100), "comp_pct_raw": F.coalesce("_c", F.lit(0.0)) * 100, "transfer_out_pct": F.coalesce("_r", F.lit(0.0)) * 100,
        "gov_pct": cap_pct(F.coalesce(ratio(num("gov_funding_federal") + F.col("verified_grants_annual"), num("total_revenue")), F.lit(0.0)) * 100),
    })
    x = x.withColumn("ghost_score", reduce(lambda a, b: a + b, [F.col(s).cast("int") for s in _GHOST_SIGNALS]))
    vehicle = F.coalesce(F.col("designation").isin("A", "B"), F.lit(False)) & F.coalesce(ratio(num("gov_funding_provincial"), num("total_revenue")) >= 0.3, F.lit(False))
    return x.where((F.col("total_revenue") > 100_000) & (F.col("ghost_score") >= 3) & ~vehicle & ~_is_public(F.col("legal_name"), PUBLIC + GHOST_ONLY) & (F.col("compensation_total") <= F.col("total_revenue") * 2))


@view("charity_metrics", "bn:s self_reported_gov_pct:d verified_grants_pct:d compensation_pct:d", "financial grants", f"""
  SELECT bn, least((coalesce(CAST(gov_funding_federal AS DOUBLE), 0)) / CAST(total_revenue AS DOUBLE) * 100, 100) AS self_reported_gov_pct, least(coalesce(CAST(total_grants AS DOUBLE) / years_active, 0) / CAST(total_revenue AS DOUBLE) * 100, 100) AS verified_grants_pct,
         CAST(coalesce(compensation, mgmt_admin_exp) AS DOUBLE) / CAST(total_revenue AS DOUBLE) * 100 AS compensation_pct
  FROM (SELECT substr(bn, 1, 9) AS bn, * EXCLUDE (bn) FROM financial WHERE total_revenue > 0 QUALIFY row_number() OVER (PARTITION BY substr(bn, 1, 9) ORDER BY fpe DESC, total_revenue) = 1) LEFT JOIN ({_G.format('2020-01-01')}) USING (bn)""")  # fmt: skip
def charity_metrics(t):
    """The three canonical shares of revenue: self-reported government money, verified grants, compensation."""
    f = _latest_filing(t["financial"].where("total_revenue > 0"), ["total_revenue", "gov_funding_federal", "compensation", "mgmt_admin_exp"])
    x = f.join(_granted(t["grants"], "2020-01-01"), "bn", "left")
    revenue = F.col("total_revenue").cast("double")
    yearly = F.coalesce(annualized(F.col("total_grants").cast("double"), F.col("years_active")), F.lit(0.0))
    return x.select("bn", cap_pct(ratio(F.coalesce(F.col("gov_funding_federal").cast("double"), F.lit(0.0)), revenue) * 100).alias("self_reported_gov_pct"), cap_pct(ratio(yearly, revenue) * 100).alias("verified_grants_pct"), (ratio(F.coalesce("compensation", "mgmt_admin_exp").cast("double"), revenue) * 100).alias("compensation_pct"))
