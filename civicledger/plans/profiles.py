"""What is known of one recipient: charity lookup, dossier, screening; and the lists that head the reports."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import bn_prefix
from ..functions.metrics import annualized, cap_pct, ratio
from ..operators.relational import top_k
from .capacity import _G, _granted, _latest_filing, ghost_capacity, zombie_recipients
from .contracts import amendment_creep, contract_growth_decomposition, contract_yoy_decomposition, same_vendor_followon, service_contracts_count, threshold_splitting, vendor_concentration, vendor_concentration_by_department
from .entities import adverse_media_matches
from .grants import duplicative_funding, duplicative_stats, policy_alignment, policy_buckets, purpose_cluster
from .guarded import run_checks
from .network import funding_reciprocals, funding_stats, governance_flow_links, related_parties_stats
from .registry import VIEWS, view

SINCE = "2020-01-01"
# The lines of the form that count employees by pay, and what they stand for.
BANDS = [
    ("300", "$1–$39,999"), ("305", "$40,000–$79,999"), ("310", "$80,000–$119,999"), ("315", "$120,000–$159,999"), ("320", "$160,000–$199,999"),
    ("325", "$200,000–$249,999"), ("330", "$250,000–$299,999"), ("335", "$300,000–$349,999"), ("340", "$350,000+"),
]


def _of(name: str) -> str:
    return f"({VIEWS[name].body})"


def category_parts(category: Column) -> tuple[Column, Column]:
    """"Group - kind - more" as the group and the rest."""
    at = F.instr(category, " - ")
    return F.trim(F.split_part(category, F.lit(" - "), F.lit(1))), F.when(at > 0, F.trim(category.substr(at + 3, F.length(category)))).otherwise("")


def sum_of_known(*values: Column) -> Column:
    """The sum of what isn't null; null if all are."""
    return F.when(F.coalesce(*values).isNotNull(), reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0)) for v in values]))


def money_text(x: Column) -> Column:
    """$1.2B, $3.4M, $5.6K, $78."""
    short = [(1e9, "B"), (1e6, "M"), (1e3, "K")]
    whole = F.format_string("$%.0f", x.cast("double"))
    text = reduce(lambda c, s: c.when(F.abs(x) >= s[0], F.format_string(f"$%.1f{s[1]}", x.cast("double") / s[0])), short[1:], F.when(F.abs(x) >= short[0][0], F.format_string("$%.1fB", x.cast("double") / 1e9))).otherwise(whole)
    return F.when(x.isNotNull(), text)


_FILED = "SELECT substr(bn, 1, 9) AS k, * EXCLUDE (bn) FROM financial WHERE total_revenue > 0 QUALIFY row_number() OVER (PARTITION BY substr(bn, 1, 9) ORDER BY fpe DESC, total_revenue) = 1"


@view("charity_lookup", "bn:s legal_name:s category:s sub_category:s designation:s city:s total_revenue:d total_expenditure:d gov_funding:d gov_pct:d other_revenue:d verified_grants_annual:d verified_grants_pct:d years_active:l compensation_total:d compensation_pct:d directors:l ft_employees:l pt_employees:l programs:l", "charities financial directors compensation programs grants", f"""
  WITH f AS ({_FILED}), g AS ({_G.format(SINCE)}), d AS (SELECT bn, count(*) AS n FROM directors GROUP BY bn), p AS (SELECT bn, count(*) AS n FROM programs GROUP BY bn),
  e AS (SELECT bn, max(ft_employees) AS ft_employees, max(pt_employees) AS pt_employees FROM compensation GROUP BY bn)
  SELECT c.bn, c.legal_name, trim(split_part(c.category, ' - ', 1)) AS category, CASE WHEN contains(c.category, ' - ') THEN trim(substr(c.category, instr(c.category, ' - ') + 3)) ELSE '' END AS sub_category, c.designation, c.city,
         total_revenue, total_expenditure, gov_funding_federal AS gov_funding, least(coalesce(CAST(gov_funding_federal AS DOUBLE), 0) / CAST(total_revenue AS DOUBLE) * 100, 100) AS gov_pct,
         CASE WHEN coalesce(gov_funding_provincial, gov_funding_other) IS NOT NULL THEN coalesce(gov_funding_provincial, 0) + coalesce(gov_funding_other, 0) END AS other_revenue,
         coalesce(CAST(total_grants AS DOUBLE) / years_active, 0) AS verified_grants_annual, least(coalesce(CAST(total_grants AS DOUBLE) / years_active, 0) / CAST(total_revenue AS DOUBLE) * 100, 100) AS verified_grants_pct, coalesce(years_active, 1) AS years_active,
         coalesce(f.compensation, mgmt_admin_exp) AS compensation_total, CAST(coalesce(f.compensation, mgmt_admin_exp) AS DOUBLE) / CAST(total_revenue AS DOUBLE) * 100 AS compensation_pct,
         coalesce(d.n, 0) AS directors, ft_employees, pt_employees, coalesce(p.n, 0) AS programs
  FROM charities c LEFT JOIN f ON f.k = substr(c.bn, 1, 9) LEFT JOIN g ON g.bn = substr(c.bn, 1, 9) LEFT JOIN d ON d.bn = c.bn LEFT JOIN p ON p.bn = c.bn LEFT JOIN e ON e.bn = c.bn""")  # fmt: skip
def charity_lookup(t):
    """A row for each listed charity: identity, latest filing with the canonical shares, people and programmes.

    Every source is brought to one row for each number before it is joined, so no join multiplies rows.
    """
    money = ["total_revenue", "total_expenditure", "gov_funding_federal", "gov_funding_provincial", "gov_funding_other", "compensation", "mgmt_admin_exp"]
    f = _latest_filing(t["financial"].where("total_revenue > 0"), money).withColumnRenamed("bn", "_p")
    g = _granted(t["grants"], SINCE).select(F.col("bn").alias("_p"), "total_grants", "years_active")
    d, p = (t[x].groupBy("bn").agg(F.count("*").alias(x)) for x in ("directors", "programs"))
    e = t["compensation"].groupBy("bn").agg(F.max("ft_employees").alias("ft_employees"), F.max("pt_employees").alias("pt_employees"))
    c = t["charities"].withColumn("_p", bn_prefix(F.col("bn"))).join(f, "_p", "left").join(g, "_p", "left").join(d, "bn", "left").join(p, "bn", "left").join(e, "bn", "left")
    group, rest = category_parts(F.col("category"))
    revenue, paid = F.col("total_revenue").cast("double"), F.coalesce("compensation", "mgmt_admin_exp")
    yearly = F.coalesce(annualized(F.col("total_grants").cast("double"), F.col("years_active")), F.lit(0.0))
    return c.select(
        "bn", "legal_name", group.alias("category"), rest.alias("sub_category"), "designation", "city", "total_revenue", "total_expenditure", F.col("gov_funding_federal").alias("gov_funding"),
        cap_pct(ratio(F.coalesce(F.col("gov_funding_federal").cast("double"), F.lit(0.0)), revenue) * 100).alias("gov_pct"), sum_of_known(F.col("gov_funding_provincial"), F.col("gov_funding_other")).alias("other_revenue"),
        yearly.alias("verified_grants_annual"), cap_pct(ratio(yearly, revenue) * 100).alias("verified_grants_pct"), F.coalesce("years_active", F.lit(1)).alias("years_active"), paid.alias("compensation_total"), (ratio(paid.cast("double"), revenue) * 100).alias("compensation_pct"),
        F.coalesce("directors", F.lit(0)).alias("directors"), "ft_employees", "pt_employees", F.coalesce("programs", F.lit(0)).alias("programs"),
    )


@view("compensation_bands", "bn:s band:s employees:d", "compensation", " UNION ALL ".join(f"SELECT bn, '{label}' AS band, TRY_CAST(json_extract_string(raw_fields, '$.\"{line}\"') AS DOUBLE) AS employees FROM compensation" for line, label in BANDS))
def compensation_bands(t):
    """Employees by pay: a row for each filer and band; null where the line is missing, empty or no number."""
    lines = F.from_json("raw_fields", "map<string,string>")
    bands = F.array(*[F.struct(F.lit(label).alias("band"), F.element_at("_l", F.lit(line)).try_cast("double").alias("employees")) for line, label in BANDS])
    return t["compensation"].withColumn("_l", F.coalesce(lines, F.create_map().cast("map<string,string>"))).select("bn", F.explode(bands).alias("b")).select("bn", "b.*")


def grants_of(t, name: str, bn: str | None, k: int = 10) -> DataFrame:
    """The k largest grants found by part of the name or by number; one found by both counts once, as by name.

    One pass over the grants tells both ways apart, so that nothing has to be merged by id afterwards.
    """
    by_name = F.contains(F.lower("recipient_legal_name"), F.lit(name.lower()))
    by_number = F.coalesce(bn_prefix(F.col("recipient_business_number")) == bn_prefix(F.lit(bn)), F.lit(False))
    found = t["grants"].where(by_name | by_number).withColumn("found_by", F.when(by_name, "name").otherwise("number")).dropDuplicates(["id"])
    return top_k(found, [F.desc_nulls_last("agreement_value"), F.asc("id")], k).select("id", "found_by", "recipient_legal_name", F.trim(F.split_part("owner_org_title", F.lit("|"), F.lit(1))).alias("department"), "prog_name_en", "agreement_value", "agreement_start_date")


_WHO, _BN = "customer#00000010", "000000100RR0001"


@view("dossier_grants", "id:l found_by:s recipient_legal_name:s department:s prog_name_en:s agreement_value:d agreement_start_date:s", "grants", f"""
  SELECT id, CASE WHEN contains(lower(recipient_legal_name), '{_WHO}') THEN 'name' ELSE 'number' END AS found_by, recipient_legal_name, trim(split_part(owner_org_title, '|', 1)) AS department, prog_name_en, agreement_value, agreement_start_date
  FROM grants WHERE contains(lower(recipient_legal_name), '{_WHO}') OR substr(recipient_business_number, 1, 9) = '{_BN[:9]}' ORDER BY agreement_value DESC NULLS LAST, id LIMIT 10""")  # fmt: skip
def dossier_grants(t):
    return grants_of(t, _WHO, _BN)


@view("dossier_counts", "grants_by_name:l grants_by_number:l grants:l contracts:l directors:l given:l received:l", "grants contracts directors transfers", f"""
  SELECT *, greatest(grants_by_name, grants_by_number) AS grants FROM (SELECT count(*) FILTER (contains(lower(recipient_legal_name), '{_WHO}')) AS grants_by_name, count(*) FILTER (substr(recipient_business_number, 1, 9) = '{_BN[:9]}') AS grants_by_number FROM grants),
    (SELECT count(*) AS contracts FROM contracts WHERE contains(lower(vendor_name), '{_WHO}')), (SELECT count(*) AS directors FROM directors WHERE bn = '{_BN}'),
    (SELECT count(*) FILTER (donor_bn = '{_BN}') AS given, count(*) FILTER (donee_bn = '{_BN}') AS received FROM transfers)""")  # fmt: skip
def dossier_counts(t, name: str = _WHO, bn: str = _BN):
    """How often an entity occurs; grants are the larger of the counts by name and by number."""
    like = lambda c: F.contains(F.lower(c), F.lit(name.lower()))
    g = t["grants"].agg(F.count_if(like("recipient_legal_name")).alias("grants_by_name"), F.count_if(bn_prefix(F.col("recipient_business_number")) == bn_prefix(F.lit(bn))).alias("grants_by_number"))
    c = t["contracts"].where(like("vendor_name")).agg(F.count("*").alias("contracts"))
    d = t["directors"].where(F.col("bn") == bn).agg(F.count("*").alias("directors"))
    f = t["transfers"].agg(F.count_if(F.col("donor_bn") == bn).alias("given"), F.count_if(F.col("donee_bn") == bn).alias("received"))
    return g.crossJoin(c).crossJoin(d).crossJoin(f).withColumn("grants", F.greatest("grants_by_name", "grants_by_number"))  # a row each


#: What screenings ask for: (part of the name, number or null).
Asked = list[tuple[str, str | None]]


def _asked_for(found: DataFrame, asked: Asked, is_it: Callable[[str, str | None], Column]) -> DataFrame:
    """`found` with a column entity: a row for each of `asked` that it is about, however many ask for it."""
    tests = [is_it(name, None if bn is None else bn.strip()[:9]) for name, bn in asked]
    about = F.filter(F.array(*[F.when(test, F.lit(name)) for test, (name, _) in zip(tests, asked, strict=True)]), lambda x: x.isNotNull())
    return found.where(reduce(lambda a, b: a | b, tests)).withColumn("entity", F.explode(about))


def _flags(make: Callable[[], DataFrame], challenge: str, severity: Column | str, evidence: Column, order: list[Column] | None = None, first: int = 1) -> Callable[[], DataFrame]:
    """A check: its flags (entity, challenge, severity, evidence), the `first` of each entity, planned when it is called."""

    def run() -> DataFrame:
        found = make()
        found = found if order is None else found.withColumn("_r", F.row_number().over(Window.partitionBy("entity").orderBy(*order))).where(F.col("_r") <= first)
        return found.select("entity", F.lit(challenge).alias("challenge"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), evidence.cast("double").alias("evidence"))

    return run


def checks_of(t, asked: Asked) -> dict[str, Callable[[], DataFrame]]:
    """The checks of all that is asked for, by number or part of the name: at most one flag each (five of wrongdoing).

    Every check makes its view once, whatever the number of entities.
    """
    numbers = [bn.strip()[:9] for _, bn in asked if bn is not None]
    like = lambda c: lambda name, _: F.contains(F.lower(c), F.lit(name.lower()))
    is_it = lambda c: lambda _, p: F.lit(False) if p is None else F.col(c) == F.lit(p)
    either = lambda a, b: lambda name, p: a(name, p) | b(name, p)
    of = lambda make, test: lambda: _asked_for(make(), asked, test)
    moved = F.coalesce("transfer_xy", F.lit(0)) + F.coalesce("transfer_yx", F.lit(0)) + F.coalesce("joint_grants_value", F.lit(0))
    z = F.when(F.col("cohort") == "cessation", "high").otherwise("medium")
    flows = of(lambda: governance_flow_links(t, numbers, contracts=False), either(is_it("bn_x"), is_it("bn_y")))
    related = _flags(flows, "related_parties", "medium", moved, [F.desc_nulls_last("rank_score"), F.asc("bn_x"), F.asc("bn_y"), F.asc("person_key")])
    return {
        "zombie": _flags(of(lambda: zombie_recipients(t), is_it("bn")), "zombie", z, F.col("total_grants"), [F.when(F.col("cohort") == "cessation", 0).otherwise(1).asc()]),
        "ghost_capacity": _flags(of(lambda: ghost_capacity(t), is_it("bn")), "ghost_capacity", "high", F.col("ghost_score")),
        "related_parties": lambda: related().where("evidence > 0"),
        "threshold_splitting": _flags(of(lambda: threshold_splitting(t), like("normalized_vendor")), "threshold_splitting", "medium", F.col("contracts_in_window"), [F.desc("contracts_in_window")]),
        "sole_source_followon": _flags(of(lambda: same_vendor_followon(t), like("normalized_vendor")), "sole_source_followon", "medium", F.col("followon_tn_count"), [F.desc_nulls_last("followon_tn_value"), F.asc("followon_tn_count")]),
        "same_purpose": _flags(of(lambda: purpose_cluster(t).where("n_departments >= 2"), either(like("recipient_legal_name"), is_it("bn_prefix"))), "same_purpose", "low", F.col("n_departments"), [F.desc("n_departments")]),
        "adverse_media": _flags(of(lambda: adverse_media_matches(t), lambda name, p: like("entity_name")(name, p) if p is None else is_it("bn")(name, p)), "adverse_media", "high", F.col("confidence"), [F.desc_nulls_last("confidence")]),
        "wrongdoing": _flags(of(lambda: t["wrongdoing"], like("owner_org_title")), "wrongdoing", "medium", F.length(F.get_json_object("raw_fields", "$.case_description_en")), [F.asc("id")], 5),
        "charity_status": _flags(lambda: _status_of(t["charities"], asked), "charity_status", "high", F.lit(None), [F.asc("bn")]),
    }


def _status_of(charities: DataFrame, asked: Asked) -> DataFrame:
    whole = dict(asked)
    lost = charities.where(F.lower("designation").rlike("revoked|annulled"))
    return _asked_for(lost, asked, lambda name, _: F.lit(False) if whole[name] is None else F.col("bn") == F.lit(whole[name]))


def screen_checks(t, name: str, bn: str | None) -> dict[str, Callable[[], DataFrame]]:
    """The checks of one entity."""
    return {check: lambda make=make: make().drop("entity") for check, make in checks_of(t, [(name, bn)]).items()}


def screen_entities(t, asked: Asked) -> DataFrame:
    """(entity, challenge, severity, evidence): the red flags of all that is asked for, as one query; checks whose tables
    are missing are left out. Names have to differ.

    A check that fails while it runs ends the query; screen_with_status() keeps the others' answers.
    """
    planned = []
    for make in checks_of(t, asked).values():
        try:
            planned.append(make())
        except (AnalysisException, KeyError):
            continue
    return reduce(DataFrame.unionByName, planned)


def screen_entity(t, name: str, bn: str | None) -> DataFrame:
    """(challenge, severity, evidence) of one entity."""
    return screen_entities(t, [(name, bn)]).drop("entity")


def screen_with_status(spark: SparkSession, t, name: str, bn: str | None, seconds: float = 60.0) -> list[dict]:
    """(check, ok, rows, error, seconds) of all checks, which run side by side."""
    return run_checks(spark, screen_checks(t, name, bn), seconds)


_SCREENED = [("supplier 00000000", "000000100RR0001"), ("customer#00000010", "000000033RR0001"), ("brand#1", None)]


def _screen_sql(name: str, bn: str | None) -> str:
    p = f"'{bn[:9]}'" if bn else "NULL"
    moved = "coalesce(transfer_xy, 0) + coalesce(transfer_yx, 0) + coalesce(joint_grants_value, 0)"
    media = f"bn = {p}" if bn else f"contains(lower(entity_name), '{name}')"
    return f"""SELECT * FROM (SELECT 'zombie' AS challenge, CASE WHEN cohort = 'cessation' THEN 'high' ELSE 'medium' END AS severity, CAST(total_grants AS DOUBLE) AS evidence FROM {_of('zombie_recipients')} WHERE bn = {p} ORDER BY cohort LIMIT 1)
  UNION ALL SELECT 'ghost_capacity', 'high', ghost_score FROM {_of('ghost_capacity')} WHERE bn = {p}
  UNION ALL SELECT 'related_parties', 'medium', m FROM (SELECT {moved} AS m FROM {_of('governance_flow_links')} WHERE bn_x = {p} OR bn_y = {p} ORDER BY rank_score DESC NULLS LAST, bn_x, bn_y, person_key LIMIT 1) WHERE m > 0
  UNION ALL SELECT * FROM (SELECT 'threshold_splitting', 'medium', contracts_in_window FROM {_of('threshold_splitting')} WHERE contains(lower(normalized_vendor), '{name}') ORDER BY contracts_in_window DESC LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 'sole_source_followon', 'medium', followon_tn_count FROM {_of('same_vendor_followon')} WHERE contains(lower(normalized_vendor), '{name}') ORDER BY followon_tn_value DESC NULLS LAST, followon_tn_count LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 'same_purpose', 'low', n_departments FROM {_of('purpose_cluster')} WHERE n_departments >= 2 AND (contains(lower(recipient_legal_name), '{name}') OR bn_prefix = {p}) ORDER BY n_departments DESC LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 'adverse_media', 'high', confidence FROM {_of('adverse_media_matches')} WHERE {media} ORDER BY confidence DESC LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 'wrongdoing', 'medium', length(json_extract_string(raw_fields, '$.case_description_en')) FROM wrongdoing WHERE contains(lower(owner_org_title), '{name}') ORDER BY id LIMIT 5)
  UNION ALL SELECT 'charity_status', 'high', NULL FROM charities WHERE bn = {f"'{bn}'" if bn else 'NULL'} AND regexp_matches(lower(designation), 'revoked|annulled')"""


_EVERYTHING = "contracts grants financial charities charity_history notices transfers directors compensation programs wrongdoing"


@view("screen_entity", "entity:s challenge:s severity:s evidence:d", _EVERYTHING, " UNION ALL ".join(f"SELECT '{n}' AS entity, * FROM ({_screen_sql(n, b)})" for n, b in _SCREENED))
def screened_entities(t):
    """Three screenings: by name and number, and by name only."""
    return screen_entities(t, _SCREENED)


_FINDINGS = f"""
  SELECT 'zombie-recipients' AS finding, count(*) AS n, NULL AS amount, NULL AS subject, NULL AS pct FROM {_of('zombie_recipients')} UNION ALL SELECT 'ghost-capacity', count(*), NULL, NULL, NULL FROM {_of('ghost_capacity')}
  UNION ALL SELECT 'funding-loops', (SELECT count(*) FROM {_of('funding_reciprocals')}), count(*), NULL, NULL FROM transfers
  UNION ALL SELECT 'amendment-creep', count(*), max(effective_value), arg_max(vendor_name, {{'a': effective_value, 'b': vendor_name}}), NULL FROM {_of('amendment_creep')}
  UNION ALL SELECT 'vendor-concentration', count(*), max(total_value), arg_max(display_name, {{'a': total_value, 'b': norm_vendor}}), 100 * CAST(max(total_value) AS DOUBLE) / (SELECT CAST(sum(effective_value) AS DOUBLE) FROM contracts WHERE commodity_type = 'S' AND effective_value > 0) FROM {_of('vendor_concentration')}
  UNION ALL SELECT 'related-parties', total_multi_board, NULL, NULL, NULL FROM {_of('related_parties_stats')}
  UNION ALL SELECT 'policy-misalignment', count(*), sum(total_value) FILTER (bucket = 'Housing'), NULL, 100 * CAST(sum(total_value) FILTER (bucket = 'Housing') AS DOUBLE) / CAST(sum(total_value) AS DOUBLE) FROM {_of('policy_buckets')}
  UNION ALL SELECT 'duplicative-funding', count(*), max(dept_count), arg_max(name, {{'a': dept_count, 'b': total_value, 'c': uname}}), NULL FROM {_of('duplicative_funding')}
  UNION ALL SELECT 'contract-intelligence', count(*), sum(total_value) FILTER (code = 'S'), NULL, 100 * CAST(sum(total_value) FILTER (code = 'S') AS DOUBLE) / CAST(sum(total_value) AS DOUBLE) FROM {_of('contract_commodity')}
  UNION ALL SELECT 'adverse-media', count(*), NULL, NULL, NULL FROM wrongdoing"""


@view("challenge_findings", "finding:s n:l amount:d subject:s pct:d", _EVERYTHING, _FINDINGS)
def challenge_findings(t):
    """The ten lines that head the challenges, from fourteen figures: a count, a value, whom it names, a share."""
    f = lambda name, df, n, amount=None, subject=None, pct=None: df.agg(
        n.alias("n"), (F.lit(None) if amount is None else amount).cast("double").alias("amount"), (F.lit(None).cast("string") if subject is None else subject).alias("subject"), (F.lit(None) if pct is None else pct).cast("double").alias("pct"),
    ).withColumn("finding", F.lit(name))
    top = lambda of, *by: F.max_by(of, F.struct(*by))
    only = lambda c, v: F.sum(F.when(F.col(c) == v, F.col("total_value")))
    share = lambda part: ratio(part.cast("double"), F.sum("total_value").cast("double")) * 100
    market = service_contracts_count(t).select(F.col("total_value").cast("double").alias("market"))
    parts = [
        f("zombie-recipients", zombie_recipients(t), F.count("*")), f("ghost-capacity", ghost_capacity(t), F.count("*")),
        f("funding-loops", funding_reciprocals(t).agg(F.count("*").alias("c")).crossJoin(funding_stats(t)), F.max("c"), F.max("total_transfers")),
        f("amendment-creep", amendment_creep(t), F.count("*"), F.max("effective_value"), top("vendor_name", "effective_value", "vendor_name")),
        f("vendor-concentration", vendor_concentration(t).crossJoin(market), F.count("*"), F.max("total_value"), top("display_name", "total_value", "norm_vendor"), ratio(F.max("total_value").cast("double"), F.max("market")) * 100),
        f("related-parties", related_parties_stats(t), F.max("total_multi_board")), f("policy-misalignment", policy_buckets(t), F.count("*"), only("bucket", "Housing"), None, share(only("bucket", "Housing"))),
        f("duplicative-funding", duplicative_funding(t), F.count("*"), F.max("dept_count"), top("name", "dept_count", "total_value", "uname")),
        f("contract-intelligence", VIEWS["contract_commodity"].build(t), F.count("*"), only("code", "S"), None, share(only("code", "S"))), f("adverse-media", t["wrongdoing"], F.count("*")),
    ]
    return reduce(DataFrame.unionByName, parts)


def finding_texts(findings: DataFrame) -> DataFrame:
    """(finding, text): each finding as a line; what has no figure says that its data is unavailable."""
    n, amount, pct = F.format_string("%,d", F.col("n")), money_text(F.col("amount")), F.format_string("%.1f%%", F.col("pct"))
    says = {
        "zombie-recipients": F.concat(n, F.lit(" recipients that depend on public money or have ceased")), "ghost-capacity": F.concat(n, F.lit(" organisations with several signs of little capacity")),
        "funding-loops": F.concat(n, F.lit(" reciprocal pairs among "), F.format_string("%,d", F.col("amount").cast("long")), F.lit(" transfers")), "amendment-creep": F.concat("subject", F.lit(": grown to "), amount, F.lit("; "), n, F.lit(" contracts flagged")),
        "vendor-concentration": F.concat("subject", F.lit(" holds "), pct, F.lit(" ("), amount, F.lit(") of service contracts")), "related-parties": F.concat(n, F.lit(" names on several boards: leads, not proof")),
        "policy-misalignment": F.concat(F.lit("Housing is "), pct, F.lit(" of classified grants")), "duplicative-funding": F.concat("subject", F.format_string(" is funded by %d departments; ", F.col("amount").cast("long")), n, F.lit(" recipients by two or more")),
        "contract-intelligence": F.concat(F.lit("Services are "), pct, F.lit(" of categorised contracts")), "adverse-media": F.concat(n, F.lit(" founded cases of wrongdoing")),
    }
    text = reduce(lambda c, k: c.when((F.col("finding") == k) & (F.col("n") > 0), says[k]), says, F.when(F.lit(False), F.lit("")))
    return findings.select("finding", F.coalesce(text, F.lit("Data unavailable")).alias("text"))


@view("concentrated_departments", "segment:s hhi:d seg_vendor_count:l norm_vendor:s total_value:d share_pct:d rnk:l", "contracts", f"""
  WITH d AS {_of('vendor_concentration_by_department')} SELECT d.segment, s.hhi, s.seg_vendor_count, d.norm_vendor, d.total_value, d.share_pct, d.rnk
  FROM d JOIN (SELECT segment, hhi, seg_vendor_count FROM d WHERE norm_vendor = '*SEGMENT*' AND seg_vendor_count >= 5 ORDER BY hhi DESC NULLS LAST, segment LIMIT 8) s ON d.segment = s.segment WHERE d.norm_vendor <> '*SEGMENT*'""")  # fmt: skip
def concentrated_departments(t, departments: int = 8, vendors: int = 5):
    """The vendors of the `departments` departments with the highest HHI among those with `vendors` vendors at least."""
    d = vendor_concentration_by_department(t)
    whole = d.where((F.col("norm_vendor") == "*SEGMENT*") & (F.col("seg_vendor_count") >= vendors))
    top = top_k(whole, [F.desc_nulls_last("hhi"), F.asc("segment")], departments).select("segment", "hhi", "seg_vendor_count")
    return d.where("norm_vendor <> '*SEGMENT*'").drop("hhi", "seg_vendor_count").join(F.broadcast(top), "segment")  # `departments` rows


def _drivers(name: str, by: str, doc: str) -> None:
    def build(t):
        g = contract_growth_decomposition(t).where("delta_total IS NOT NULL")
        return top_k(g, [F.desc_nulls_last(by), F.asc("commodity_type"), F.asc("fiscal_year")], 10)

    build.__doc__ = doc
    columns = "commodity_type:s fiscal_year:l total_value:d delta_total:d volume_component:d unit_cost_component:d concentration_change:d"
    view(name, columns, "contracts", f"SELECT * FROM {_of('contract_growth_decomposition')} WHERE delta_total IS NOT NULL ORDER BY {by} DESC NULLS LAST, commodity_type, fiscal_year LIMIT 10")(build)


_drivers("growth_events", "delta_total", "The ten largest rises of a category's spend.")
_drivers("unit_cost_drivers", "unit_cost_component", "The ten largest rises by dearer contracts.")
_drivers("concentration_drivers", "concentration_change", "The ten largest rises of concentration.")


@view("latest_bucket_changes", "owner_org_title:s commodity_type:s fiscal_year:l delta_total_pct:d delta_count_pct:d delta_avg_pct:d delta_hhi:d", "contracts", f"""
  WITH y AS {_of('contract_yoy_decomposition')} SELECT * FROM y WHERE delta_total_pct IS NOT NULL AND fiscal_year = (SELECT max(fiscal_year) FROM y WHERE total_prev IS NOT NULL AND fiscal_year < 2022)""")  # fmt: skip
def latest_bucket_changes(t, before: int = 2022):
    """Changes of the last whole year (before `before`, the current one) by department and category."""
    y = contract_yoy_decomposition(t).where("total_prev IS NOT NULL").where(F.col("fiscal_year") < before)
    y = y.withColumn("_last", F.max("fiscal_year").over(Window.partitionBy(F.lit(1))))  # a row for each year of the top pairs
    return y.where("fiscal_year = _last AND delta_total_pct IS NOT NULL").drop("_last")


_BUCKETS = "owner_org_title:s commodity_type:s fiscal_year:l delta_total_pct:d delta_count_pct:d delta_avg_pct:d delta_hhi:d"


@view("unit_cost_buckets", _BUCKETS, "contracts", f"SELECT * FROM {_of('latest_bucket_changes')} WHERE delta_total_pct > 5 AND delta_count_pct < 0")
def unit_cost_buckets(t):
    """Buckets whose spend rose although there were fewer contracts: dearer ones."""
    return latest_bucket_changes(t).where("delta_total_pct > 5 AND delta_count_pct < 0")


@view("concentration_buckets", _BUCKETS, "contracts", f"SELECT * FROM {_of('latest_bucket_changes')} WHERE delta_hhi > 200")
def concentration_buckets(t):
    """Buckets in which fewer vendors came to hold more."""
    return latest_bucket_changes(t).where("delta_hhi > 200")


@view("alignment_totals", "committed:d annual_target:d annual_actual:d annual_gap:d", "grants policy_targets", f"""
  SELECT sum(total_commitment_cad) AS committed, sum(annual_target) AS annual_target, sum(annual_actual) AS annual_actual, sum(annual_target) - sum(annual_actual) AS annual_gap FROM {_of('policy_alignment')}""")  # fmt: skip
def alignment_totals(t):
    a = policy_alignment(t)
    return a.agg(F.sum("total_commitment_cad").alias("committed"), F.sum("annual_target").alias("annual_target"), F.sum("annual_actual").alias("annual_actual"), (F.sum("annual_target") - F.sum("annual_actual")).alias("annual_gap"))


@view("same_name_boards", "name:s boards:a board_count:l", "directors", """
  SELECT upper(last_name) || ', ' || upper(first_name) AS name, list_sort(list(DISTINCT bn)) AS boards, count(DISTINCT bn) AS board_count FROM directors GROUP BY 1 HAVING count(DISTINCT bn) >= 2""")  # fmt: skip
def same_name_boards(t):
    """Names that sit on two boards or more, whoever bears them."""
    n = t["directors"].groupBy(F.concat(F.upper("last_name"), F.lit(", "), F.upper("first_name")).alias("name")).agg(F.array_sort(F.collect_set("bn")).alias("boards"))
    return n.withColumn("board_count", F.size("boards")).where("board_count >= 2")
