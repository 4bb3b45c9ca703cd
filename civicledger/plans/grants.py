"""Views over grants: duplicate funding, purpose, policy alignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import bn_prefix
from .registry import VIEWS, view

# Policy areas by words in the program's name, first match wins.
BUCKETS = [
    ("Climate/Environment", "climate|environment|green|emissions|clean energy|ecological|conservation|biodiversity|pollution|sustainable"),
    ("Housing", "housing|homelessness|shelter|affordable|unhoused"),
    ("Healthcare", "health|medical|hospital|pandemic|nursing|addiction|opioid|substance"),
    ("Indigenous", "indigenous|first nations|inuit|reconciliation|aboriginal|treaty"),
    ("Innovation/Economy", "innovation|economic|business|trade|technology|digital|startup|entrepreneur|research|science"),
    ("Agriculture", "agriculture|farm|agri|food|livestock|dairy|crop|fishery|aquaculture"),
]
# Purpose themes by whole words in program and description, first match wins.
THEMES = [
    ("housing", "housing|homeless|shelter|rent supplement|affordable home|co-?op housing"),
    ("mental_health", "mental health|psychiatric|suicide|addiction|substance use|opioid"),
    ("indigenous", "indigenous|first nations?|inuit|m[eé]tis|aboriginal|reconciliation"),
    ("climate", "climate|emissions?|greenhouse|net.?zero|decarboniz|clean energy|renewable energy"),
    ("research", "research|innovation|scientif|laboratory|nserc|cihr|sshrc|r&d"),
    ("child_care", "child ?care|early learning|early childhood"),
    ("settlement", "immigrant|newcomer|settlement services|refugee|asylum"),
    ("official_languages", "official languages?|francoph"),
    ("veterans", "veterans?"),
    ("seniors", "seniors?|elderly|aging"),
    ("youth", "youth"),
    ("women_gender", "women|gender|gender-based violence|domestic violence"),
    ("skills_employment", "skills|workforce|apprentice|employment program"),
    ("agriculture", "agricultur|farm|food security"),
    ("arts_culture", "arts|culture|heritage|museum|festival"),
]


def ladder(text, rules, pattern):
    """CASE: the label of the first rule whose pattern the text has, else null."""
    return reduce(lambda c, r: c.when(text.rlike(pattern.format(r[1])), F.lit(r[0])), rules[1:], F.when(text.rlike(pattern.format(rules[0][1])), F.lit(rules[0][0])))


@view("grants_summary", "total_grants:l total_value:d", "grants", "SELECT count(*) AS total_grants, coalesce(sum(agreement_value), 0) AS total_value FROM grants")
def grants_summary(t):
    return t["grants"].agg(F.count("*").alias("total_grants"), F.coalesce(F.sum("agreement_value"), F.lit(0)).alias("total_value"))


_COUNTED = ("contracts", "grants", "charities", "financial", "directors", "transfers", "notices")


@view("table_counts", "tbl:s n:l", " ".join(_COUNTED), " UNION ALL ".join(f"SELECT '{n}' AS tbl, count(*) AS n FROM {n}" for n in _COUNTED))
def table_counts(t):
    return reduce(DataFrame.unionByName, [t[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("tbl"), "n") for n in _COUNTED])


_BUCKET_SQL = " ".join(f"WHEN regexp_matches(lower(prog_name_en), '{p}') THEN '{b}'" for b, p in BUCKETS)


@view("policy_buckets", "bucket:s total_value:d grant_count:l", "grants", f"SELECT CASE {_BUCKET_SQL} ELSE 'Other' END AS bucket, sum(agreement_value) AS total_value, count(*) AS grant_count FROM grants GROUP BY ALL")
def policy_buckets(t):
    """Grants by policy area. Patterns run on program names, of which there are few, not on grants."""
    programs = t["grants"].groupBy("prog_name_en").agg(F.sum("agreement_value").alias("v"), F.count("*").alias("n"))
    area = F.coalesce(ladder(F.lower("prog_name_en"), BUCKETS, "{0}"), F.lit("Other"))
    return programs.groupBy(area.alias("bucket")).agg(F.coalesce(F.sum("v"), F.lit(0)).alias("total_value"), F.sum("n").alias("grant_count"))


@view("policy_alignment", "id:s name:s department:s announced_year:l total_commitment_cad:d annual_target:d total_matched:d grant_count:l years_observed:l annual_actual:d annual_gap:d gap_pct:d", "grants policy_targets", """
  SELECT *, annual_target - annual_actual AS annual_gap, 100.0 * (annual_target - annual_actual) / annual_target AS gap_pct FROM (
    SELECT *, CASE WHEN grant_count > 0 THEN CAST(total_matched AS DOUBLE) / years_observed END AS annual_actual FROM (
      SELECT p.id, p.name, p.department, p.announced_year, p.total_commitment_cad, p.annual_target, coalesce(sum(agreement_value), 0) AS total_matched, count(agreement_value) AS grant_count,
             greatest(1, year(max(agreement_start_date)) - year(min(agreement_start_date)) + 1) AS years_observed
      FROM policy_targets p LEFT JOIN grants g ON agreement_start_date >= target_start AND agreement_start_date < target_end
        AND (regexp_matches(lower(prog_name_en), match_regex) OR regexp_matches(lower(coalesce(description_en, '')), match_regex)) GROUP BY ALL))""")  # fmt: skip
def policy_alignment(t):
    """What each commitment planned a year against what grants that its words find have paid a year.

    Grants are first summed by texts and day, so that each pattern meets a text once and not once a grant; the
    commitments, a seeded list of a few rows, are broadcast. Years are one at least. Nothing is known of what a
    commitment without a grant has paid a year: its actual and its gap are null.
    """
    texts = t["grants"].where("agreement_value IS NOT NULL").groupBy("prog_name_en", "description_en", "agreement_start_date").agg(F.sum("agreement_value").alias("v"), F.count("*").alias("n"))
    targets = t["policy_targets"]
    p = F.broadcast(targets.select(F.col("id").alias("_id"), "target_start", "target_end", F.concat(F.lit("(?iu)"), F.col("match_regex")).alias("_re")))
    hit = F.coalesce(F.rlike("prog_name_en", F.col("_re")), F.lit(False)) | F.coalesce(F.rlike("description_en", F.col("_re")), F.lit(False))
    found = texts.join(p, (F.col("agreement_start_date") >= F.col("target_start")) & (F.col("agreement_start_date") < F.col("target_end")) & hit)
    years = F.year(F.max("agreement_start_date")) - F.year(F.min("agreement_start_date")) + 1
    sums = found.groupBy("_id").agg(F.sum("v").alias("total_matched"), F.sum("n").alias("grant_count"), years.alias("years_observed"))
    out = targets.join(sums, F.col("id") == F.col("_id"), "left").withColumn("years_observed", F.greatest(F.lit(1), F.col("years_observed")))
    out = out.withColumn("annual_actual", F.col("total_matched").cast("double") / F.col("years_observed"))
    out = out.fillna(0, ["grant_count"]).withColumn("total_matched", F.coalesce("total_matched", F.lit(0)))
    out = out.withColumn("annual_gap", F.col("annual_target") - F.col("annual_actual"))
    return out.withColumn("gap_pct", F.when(F.col("annual_target") > 0, 100.0 * F.col("annual_gap") / F.col("annual_target")).otherwise(0.0))


_DUPLICATE_SQL = """SELECT upper(recipient_legal_name) AS uname, min(recipient_legal_name) AS name, count(DISTINCT owner_org_title) AS dept_count, count(*) AS grant_count, sum(agreement_value) AS total_value,
  array_to_string(list_sort(list(DISTINCT owner_org_title)), '; ') AS departments FROM grants WHERE recipient_legal_name <> '' AND owner_org_title <> '' GROUP BY 1 HAVING count(DISTINCT owner_org_title) >= 2"""


@view("duplicative_funding", "uname:s name:s dept_count:l grant_count:l total_value:d departments:s", "grants", _DUPLICATE_SQL)
def duplicative_funding(t):
    """Recipients, by upper-case name, that two departments or more fund."""
    g = t["grants"].where("recipient_legal_name <> '' AND owner_org_title <> ''").groupBy(F.upper("recipient_legal_name").alias("uname"))
    departments = F.array_sort(F.collect_set("owner_org_title"))
    out = g.agg(F.min("recipient_legal_name").alias("name"), departments.alias("_d"), F.count("*").alias("grant_count"), F.coalesce(F.sum("agreement_value"), F.lit(0)).alias("total_value"))
    return out.where(F.size("_d") >= 2).withColumns({"dept_count": F.size("_d"), "departments": F.array_join("_d", "; ")}).drop("_d")


@view("duplicative_stats", "total_multi_dept:l max_depts:l total_value:d", "grants", f"SELECT count(*) AS total_multi_dept, max(dept_count) AS max_depts, coalesce(sum(total_value), 0) AS total_value FROM ({_DUPLICATE_SQL})")
def duplicative_stats(t):
    return duplicative_funding(t).agg(F.count("*").alias("total_multi_dept"), F.max("dept_count").alias("max_depts"), F.coalesce(F.sum("total_value"), F.lit(0)).alias("total_value"))


@view("purpose_overlap", "recip_key:s recipient_legal_name:s prog_key:s prog_name_en:s dept_count:l grant_count:l total_value:d departments:s first_date:s last_date:s", "grants", """
  SELECT upper(trim(recipient_legal_name)) AS recip_key, max(recipient_legal_name) AS recipient_legal_name, upper(trim(prog_name_en)) AS prog_key, max(prog_name_en) AS prog_name_en, count(DISTINCT owner_org_title) AS dept_count,
         count(*) AS grant_count, sum(agreement_value) AS total_value, array_to_string(list_sort(list(DISTINCT owner_org_title)), ' | ') AS departments, min(agreement_start_date) AS first_date, max(agreement_start_date) AS last_date
  FROM grants WHERE agreement_value > 0 AND owner_org_title IS NOT NULL AND prog_name_en IS NOT NULL AND recipient_legal_name IS NOT NULL GROUP BY 1, 3 HAVING count(DISTINCT owner_org_title) >= 2""")  # fmt: skip
def purpose_overlap(t):
    """One recipient, one program, two departments or more: one aggregation, as sets of departments add up."""
    g = t["grants"].where("agreement_value > 0 AND owner_org_title IS NOT NULL AND recipient_legal_name IS NOT NULL AND prog_name_en IS NOT NULL")
    out = g.groupBy(F.upper(F.trim("recipient_legal_name")).alias("recip_key"), F.upper(F.trim("prog_name_en")).alias("prog_key")).agg(
        F.max("recipient_legal_name").alias("recipient_legal_name"), F.max("prog_name_en").alias("prog_name_en"), F.array_sort(F.collect_set("owner_org_title")).alias("_d"),
        F.count("*").alias("grant_count"), F.sum("agreement_value").alias("total_value"), F.min("agreement_start_date").alias("first_date"), F.max("agreement_start_date").alias("last_date"),
    )
    return out.where(F.size("_d") >= 2).withColumns({"dept_count": F.size("_d"), "departments": F.array_join("_d", " | ")}).drop("_d")


_THEME_SQL = " ".join(f"WHEN regexp_matches(words, '\\b({p})\\b') THEN '{n}'" for n, p in THEMES)


@view("purpose_cluster", "recip_key:s bn_prefix:s recipient_legal_name:s purpose_cluster:s n_departments:l n_programs:l grant_count:l total_value:d departments:s programs:s", "grants", f"""
  SELECT recip_key, max(bn_prefix) AS bn_prefix, max(recipient_legal_name) AS recipient_legal_name, theme AS purpose_cluster, count(DISTINCT owner_org_title) AS n_departments, count(DISTINCT prog_name_en) AS n_programs,
         count(*) AS grant_count, sum(agreement_value) AS total_value, array_to_string(list_sort(list(DISTINCT owner_org_title)), ' | ') AS departments,
         array_to_string(list_sort(list(DISTINCT owner_org_title || ': ' || prog_name_en)), '; ') AS programs
  FROM (SELECT *, coalesce(nullif(substr(recipient_business_number, 1, 9), ''), 'NM:' || upper(trim(recipient_legal_name))) AS recip_key, CASE WHEN length(recipient_business_number) >= 9 THEN substr(recipient_business_number, 1, 9) END AS bn_prefix,
          CASE {_THEME_SQL} END AS theme FROM (SELECT *, lower(prog_name_en) || ' ' || lower(coalesce(description_en, '')) AS words FROM grants))
  WHERE theme IS NOT NULL AND agreement_value > 0 GROUP BY recip_key, theme HAVING count(DISTINCT owner_org_title) >= 2 AND count(DISTINCT prog_name_en) >= 2""")  # fmt: skip
def purpose_cluster(t):
    """One recipient and theme under two departments or more and two programs or more.

    Fifteen patterns meet each different text once, and not each grant.
    """
    g = t["grants"].where("agreement_value > 0 AND owner_org_title IS NOT NULL AND recipient_legal_name IS NOT NULL AND prog_name_en IS NOT NULL")
    words = F.concat_ws(" ", F.lower("prog_name_en"), F.coalesce(F.lower("description_en"), F.lit("")))
    number = F.col("recipient_business_number")
    name = F.concat(F.lit("NM:"), F.upper(F.trim("recipient_legal_name")))
    texts = g.select("prog_name_en", "description_en").distinct().withColumn("purpose_cluster", ladder(words, THEMES, r"\b({0})\b")).where("purpose_cluster IS NOT NULL")
    texts = texts.withColumnsRenamed({"prog_name_en": "_program", "description_en": "_description"})
    g = g.join(texts, (F.col("prog_name_en") == F.col("_program")) & F.col("description_en").eqNullSafe(F.col("_description"))).drop("_program", "_description")
    g = g.withColumns({"recip_key": F.coalesce(F.nullif(F.substring(number, 1, 9), F.lit("")), name), "bn_prefix": bn_prefix(number)})
    out = g.groupBy("recip_key", "purpose_cluster").agg(
        F.max("bn_prefix").alias("bn_prefix"), F.max("recipient_legal_name").alias("recipient_legal_name"), F.array_sort(F.collect_set(F.struct(F.col("owner_org_title").alias("dept"), F.col("prog_name_en").alias("program")))).alias("_p"),
        F.count("*").alias("grant_count"), F.sum("agreement_value").alias("total_value"),
    )
    departments, programs = F.array_distinct(F.transform("_p", lambda x: x["dept"])), F.array_distinct(F.transform("_p", lambda x: x["program"]))
    out = out.withColumns({"n_departments": F.size(departments), "n_programs": F.size(programs), "departments": F.array_join(departments, " | "), "programs_json": F.to_json("_p")})
    out = out.withColumn("programs", F.array_join(F.array_sort(F.transform("_p", lambda x: F.concat(x["dept"], F.lit(": "), x["program"]))), "; "))
    return out.where("n_departments >= 2 AND n_programs >= 2").drop("_p")


@view("purpose_programs", "recip_key:s purpose_cluster:s programs_json:s", "grants", f"""
  SELECT recip_key, theme AS purpose_cluster, CAST(to_json(list_sort(list(DISTINCT {{'dept': owner_org_title, 'program': prog_name_en}}))) AS VARCHAR) AS programs_json
  FROM (SELECT *, coalesce(nullif(substr(recipient_business_number, 1, 9), ''), 'NM:' || upper(trim(recipient_legal_name))) AS recip_key, CASE {_THEME_SQL} END AS theme FROM (SELECT *, lower(prog_name_en) || ' ' || lower(coalesce(description_en, '')) AS words FROM grants))
  WHERE theme IS NOT NULL AND agreement_value > 0 GROUP BY recip_key, theme HAVING count(DISTINCT owner_org_title) >= 2 AND count(DISTINCT prog_name_en) >= 2""")  # fmt: skip
def purpose_programs(t):
    """The departments and programs of each overlap, as JSON objects."""
    return purpose_cluster(t).select("recip_key", "purpose_cluster", "programs_json")


@view("cluster_by_theme", "purpose_cluster:s recipients:l grants:l total_value:d", "grants", f"SELECT purpose_cluster, count(*) AS recipients, sum(grant_count) AS grants, sum(total_value) AS total_value FROM ({VIEWS['purpose_cluster'].body}) GROUP BY 1")
def cluster_by_theme(t):
    return purpose_cluster(t).groupBy("purpose_cluster").agg(F.count("*").alias("recipients"), F.sum("grant_count").alias("grants"), F.sum("total_value").alias("total_value"))


@view("policy_gap", "id:s allocated:d scheduled:d fulfillment_pct:d", "grants policy_targets", """
  SELECT p.id, coalesce(sum(agreement_value), 0) AS allocated, sched AS scheduled, 100.0 * CAST(coalesce(sum(agreement_value), 0) AS DOUBLE) / sched AS fulfillment_pct FROM (
    SELECT *, CAST(total_commitment_cad AS DOUBLE) * least(1.0, CAST(DATE '2021-06-30' - target_start AS DOUBLE) / (target_end - target_start)) AS sched FROM policy_targets) p
  LEFT JOIN grants g ON agreement_start_date >= target_start AND agreement_start_date <= DATE '2021-06-30' AND regexp_matches(lower(prog_name_en), match_regex)
  GROUP BY p.id, sched HAVING 100.0 * CAST(coalesce(sum(agreement_value), 0) AS DOUBLE) / sched < 50""")  # fmt: skip
def policy_gap(t, as_of: str = "2021-06-30", below: float = 50.0):
    """Commitments of which less than `below` percent of what a linear schedule had due by `as_of` has been granted."""
    day = F.lit(as_of).cast("date")
    part = F.least(F.lit(1.0), F.date_diff(day, F.col("target_start")).cast("double") / F.date_diff("target_end", "target_start"))
    targets = F.broadcast(t["policy_targets"].withColumn("scheduled", F.col("total_commitment_cad").cast("double") * part).select("id", "target_start", "scheduled", F.concat(F.lit("(?iu)"), "match_regex").alias("_re")))
    days = t["grants"].groupBy("prog_name_en", "agreement_start_date").agg(F.sum("agreement_value").alias("v"))
    hit = (F.col("agreement_start_date") >= F.col("target_start")) & (F.col("agreement_start_date") <= day) & F.rlike("prog_name_en", F.col("_re"))
    paid = days.join(targets, hit).groupBy("id").agg(F.sum("v").alias("v"))
    out = targets.join(paid, "id", "left").select("id", F.coalesce("v", F.lit(0)).alias("allocated"), "scheduled")
    return out.withColumn("fulfillment_pct", 100.0 * F.col("allocated").cast("double") / F.col("scheduled")).where(F.col("fulfillment_pct") < below)


@view("search_grants", "recipient_legal_name:s owner_org_title:s prog_name_en:s agreement_value:d agreement_start_date:s", "grants", """
  SELECT * FROM grants WHERE contains(lower(prog_name_en), 'housing') AND recipient_type = 'G' ORDER BY agreement_value DESC, recipient_legal_name, agreement_start_date LIMIT 100""")  # fmt: skip
def search_grants(t, program: str = "housing", kind: str = "G", limit: int = 100):
    rows = t["grants"].where(F.contains(F.lower("prog_name_en"), F.lit(program.lower())) & (F.col("recipient_type") == kind))
    return rows.orderBy(F.desc_nulls_last("agreement_value"), "recipient_legal_name", "agreement_start_date").limit(min(limit, 100))


@view("facets", "facet:s value:s n:l", "grants", """
  SELECT facet, value, count(*) AS n FROM (SELECT unnest(['department', 'program', 'province']) AS facet, unnest([owner_org_title, prog_name_en, recipient_province]) AS value FROM grants) GROUP BY ALL""")  # fmt: skip
def facets(t):
    """Counts for each value of each facet column, in one scan."""
    columns = {"department": "owner_org_title", "program": "prog_name_en", "province": "recipient_province"}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("facet"), F.col(c).alias("value")) for k, c in columns.items()]))
    return t["grants"].select(pairs.alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))
