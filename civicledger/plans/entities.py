"""Matching of enforcement notices, and composite reports about one entity or all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import PLAIN, ACCENTED, ENTITY_SUFFIXES, bn_guess, bn_prefix, normalize_entity
from ..functions.metrics import ratio
from ..operators import matching
from ..operators.relational import top_k
from ..sources.sinks import stored
from .capacity import zombie_recipients
from .contracts import competitive_to_sole_source, threshold_splitting, vendor_concentration
from .grants import duplicative_funding
from .network import funding_stats
from .registry import VIEWS, view


def entity_universe(t) -> DataFrame:
    """(source, entity_name, name_norm, bn): charities, recipients of two grants or more, vendors of three contracts or more."""
    c = t["charities"].select(F.lit("charity").alias("source"), F.col("legal_name").alias("entity_name"), bn_prefix(F.col("bn")).alias("bn"))
    g = t["grants"].groupBy("recipient_legal_name", bn_prefix(F.col("recipient_business_number")).alias("bn")).count().where("count >= 2")
    g = g.select(F.lit("grant").alias("source"), F.col("recipient_legal_name").alias("entity_name"), "bn")
    v = t["contracts"].groupBy("vendor_name").count().where("count >= 3").select(F.lit("contract").alias("source"), F.col("vendor_name").alias("entity_name"), F.lit(None).cast("string").alias("bn"))
    return c.unionByName(g).unionByName(v).withColumn("name_norm", normalize_entity(F.col("entity_name")))


_NORM = rf"regexp_replace(trim(regexp_replace(regexp_replace(translate(upper({{0}}), '{ACCENTED}', '{PLAIN}'), '[[:punct:]]', ' ', 'g'), '\s+', ' ', 'g')), '( ({'|'.join(ENTITY_SUFFIXES)}))+$', '')"
_UNIVERSE = f"""SELECT *, {_NORM.format('entity_name')} AS name_norm FROM (
  SELECT 'charity' AS source, legal_name AS entity_name, substr(bn, 1, 9) AS bn FROM charities
  UNION ALL SELECT 'grant', recipient_legal_name, substr(recipient_business_number, 1, 9) FROM grants GROUP BY ALL HAVING count(*) >= 2
  UNION ALL SELECT 'contract', vendor_name, NULL FROM contracts GROUP BY ALL HAVING count(*) >= 3)"""
_MATCHES = rf"""WITH n AS (SELECT id, severity, {_NORM.format('entity_name_raw')} AS name_norm, nullif(regexp_extract(details, '\b(\d{{9}})\b', 1), '') AS bn_guess FROM notices), u AS ({_UNIVERSE}),
  b AS (SELECT DISTINCT id AS notice_id, source, entity_name, bn FROM n JOIN u ON bn_guess = bn),
  e AS (SELECT DISTINCT id AS notice_id, source, entity_name, bn FROM n JOIN u USING (name_norm) WHERE length(name_norm) >= 4)
  SELECT *, 'exact_bn' AS method, 1.0 AS confidence FROM b UNION ALL SELECT *, 'exact_name', 0.95 FROM e WHERE (notice_id, source, entity_name) NOT IN (SELECT (notice_id, source, entity_name) FROM b)"""


def _notices(t) -> DataFrame:
    return t["notices"].select(F.col("id").alias("notice_id"), "severity", normalize_entity(F.col("entity_name_raw")).alias("name_norm"), bn_guess(F.col("details")).alias("bn_guess"))


@view("adverse_media_matches", "notice_id:l source:s entity_name:s bn:s method:s confidence:d", "notices charities grants contracts", _MATCHES)
def adverse_media_matches(t):
    return matching.match_entities(_notices(t), entity_universe(t))


def _vector_sql(name: str) -> str:
    triples = f"[(ascii(substr({name}, i, 1)) * 961 + ascii(substr({name}, i + 1, 1)) * 31 + ascii(substr({name}, i + 2, 1))) % 256 FOR i IN range(1, length({name}) - 1)]"
    return f"list_transform(range(256), lambda k: CAST(len(list_filter({triples}, lambda x: x = k)) AS DOUBLE))"


_BY_VECTOR = rf"""WITH m AS ({_MATCHES}), u0 AS ({_UNIVERSE}),
  k AS (SELECT * FROM u0 WHERE length(name_norm) >= 4 QUALIFY row_number() OVER (PARTITION BY name_norm ORDER BY source, entity_name, bn NULLS FIRST) = 1), u AS (SELECT *, {_vector_sql('name_norm')} AS v FROM k),
  p AS (SELECT id, {_NORM.format('entity_name_raw')} AS name_norm FROM notices WHERE id NOT IN (SELECT notice_id FROM m)), d AS (SELECT name_norm, {_vector_sql('name_norm')} AS v FROM (SELECT DISTINCT name_norm FROM p WHERE length(name_norm) >= 4)),
  b AS (SELECT d.name_norm, u.source, u.entity_name, u.bn, round(list_cosine_similarity(d.v, u.v), 12) AS confidence FROM d, u QUALIFY row_number() OVER (PARTITION BY d.name_norm ORDER BY round(list_cosine_similarity(d.v, u.v), 12) DESC, u.name_norm) = 1)
  SELECT id AS notice_id, source, entity_name, bn, 'vector_cosine' AS method, confidence FROM p JOIN b USING (name_norm) WHERE confidence >= 0.72"""


def _matched(t) -> tuple[DataFrame, DataFrame]:
    """Matches by number and name, and those of what these left by the most similar name; entities and matches are made once."""
    notices, entities = _notices(t), stored(entity_universe(t), "entities")
    exact = stored(matching.match_entities(notices, entities), "matches")
    left_over = notices.join(exact.select("notice_id").distinct().hint("merge"), "notice_id", "left_anti")
    return exact, matching.match_by_vector(left_over, entities)


def vector_matches(t) -> DataFrame:
    """What number and name left, matched to the most similar name."""
    return _matched(t)[1]


@view("adverse_media_vector_matches", "notice_id:l confidence:d", "notices charities grants contracts", f"SELECT notice_id, confidence FROM ({_BY_VECTOR})")
def adverse_media_vector_matches(t):
    return vector_matches(t)


@view("adverse_media_all_matches", "notice_id:l source:s entity_name:s bn:s method:s confidence:d", "notices charities grants contracts", f"({_MATCHES}) UNION ALL ({_BY_VECTOR})")
def adverse_media_all_matches(t):
    """All matches in one table: by number, by name, and for what is left by the nearest vector."""
    exact, by_vector = _matched(t)
    return exact.unionByName(by_vector)


@view("adverse_media_report", "severity:s method:s matches:l notices:l granted:d contracted:d", "notices charities grants contracts", f"""
  SELECT severity, method, count(*) AS matches, count(DISTINCT notice_id) AS notices, coalesce(sum(g.v), 0) AS granted, coalesce(sum(c.v), 0) AS contracted
  FROM ({_MATCHES}) m JOIN notices ON id = notice_id LEFT JOIN (SELECT substr(recipient_business_number, 1, 9) AS k, sum(agreement_value) AS v FROM grants WHERE recipient_business_number IS NOT NULL GROUP BY 1) g ON g.k = m.bn
  LEFT JOIN (SELECT upper(vendor_name) AS k, sum(effective_value) AS v FROM contracts GROUP BY 1) c ON c.k = upper(entity_name) GROUP BY ALL""")  # fmt: skip
def adverse_media_report(t):
    """Matches by severity and method, with what the matched entities were granted and sold."""
    m = adverse_media_matches(t).join(t["notices"].select(F.col("id").alias("notice_id"), "severity"), "notice_id")
    g = t["grants"].where("recipient_business_number IS NOT NULL").groupBy(bn_prefix(F.col("recipient_business_number")).alias("bn")).agg(F.sum("agreement_value").alias("_g"))
    c = t["contracts"].groupBy(F.upper("vendor_name").alias("_k")).agg(F.sum("effective_value").alias("_c"))
    m = m.join(g, "bn", "left").join(c, F.upper("entity_name") == F.col("_k"), "left")
    return m.groupBy("severity", "method").agg(F.count("*").alias("matches"), F.count_distinct("notice_id").alias("notices"), F.coalesce(F.sum("_g"), F.lit(0)).alias("granted"), F.coalesce(F.sum("_c"), F.lit(0)).alias("contracted"))


def dossier(t, name: str) -> DataFrame:
    """One row of what is known of an entity: found by part of its name, and by the number of the first charity found."""
    part = name.lower()
    like = lambda c: F.contains(F.lower(c), F.lit(part))
    found = t["charities"].where(like("legal_name")).agg(F.min_by(bn_prefix(F.col("bn")), F.struct("legal_name", "bn")).alias("bn"), F.min("legal_name").alias("legal_name"))
    c = t["contracts"].where(like("vendor_name")).agg(F.count("*").alias("contracts"), F.sum("effective_value").alias("contract_value"), F.count_if(F.col("solicitation_procedure") == "TN").alias("sole_source"))
    g = t["grants"].where(like("recipient_legal_name")).agg(F.count("*").alias("grants"), F.sum("agreement_value").alias("grant_value"), F.count_distinct("owner_org_title").alias("departments"))
    out = t["transfers"].groupBy(bn_prefix(F.col("donor_bn")).alias("bn")).agg(F.sum("total_gifts").alias("given"))
    seats = t["directors"].groupBy(bn_prefix(F.col("bn")).alias("bn")).agg(F.count("*").alias("directors"))
    one = F.broadcast(found.crossJoin(c).crossJoin(g))  # a row
    return one.join(out, "bn", "left").join(seats, "bn", "left")


@view("entity_dossier", "bn:s legal_name:s contracts:l contract_value:d sole_source:l grants:l grant_value:d departments:l given:d directors:l", "charities contracts grants transfers directors", """
  SELECT *, (SELECT sum(total_gifts) FROM transfers WHERE substr(donor_bn, 1, 9) = f.bn) AS given, (SELECT nullif(count(*), 0) FROM directors d WHERE substr(d.bn, 1, 9) = f.bn) AS directors FROM
    (SELECT arg_min(substr(bn, 1, 9), {'a': legal_name, 'b': bn}) AS bn, min(legal_name) AS legal_name FROM charities WHERE contains(lower(legal_name), 'customer#0000001')) f,
    (SELECT count(*) AS contracts, sum(effective_value) AS contract_value, count(*) FILTER (solicitation_procedure = 'TN') AS sole_source FROM contracts WHERE contains(lower(vendor_name), 'customer#0000001')),
    (SELECT count(*) AS grants, sum(agreement_value) AS grant_value, count(DISTINCT owner_org_title) AS departments FROM grants WHERE contains(lower(recipient_legal_name), 'customer#0000001'))""")  # fmt: skip
def entity_dossier(t):
    return dossier(t, "Customer#0000001")


def screen(t) -> DataFrame:
    """(entity, flag, severity): red flags of all entities, as a union of the views that raise them."""
    parts = [
        zombie_recipients(t).select(F.col("legal_name").alias("entity"), F.col("cohort").alias("flag"), F.lit("high").alias("severity")),
        competitive_to_sole_source(t).select("normalized_vendor").distinct().select(F.col("normalized_vendor").alias("entity"), F.lit("turned_sole_source").alias("flag"), F.lit("medium").alias("severity")),
        threshold_splitting(t).select("normalized_vendor").distinct().select(F.col("normalized_vendor").alias("entity"), F.lit("threshold_splitting").alias("flag"), F.lit("medium").alias("severity")),
        matching.matched_names(_notices(t), entity_universe(t)).select(F.col("entity_name").alias("entity"), F.lit("adverse_media").alias("flag"), F.lit("high").alias("severity")),
        duplicative_funding(t).where("dept_count >= 4").select(F.col("name").alias("entity"), F.lit("many_departments").alias("flag"), F.lit("low").alias("severity")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _of(name: str) -> str:
    return f"({VIEWS[name].body})"


_ALL = "contracts grants financial charities charity_history notices transfers"
view("screen_flags", "entity:s flag:s severity:s", _ALL, f"""
  SELECT legal_name AS entity, cohort AS flag, 'high' AS severity FROM {_of('zombie_recipients')} UNION ALL SELECT DISTINCT normalized_vendor, 'turned_sole_source', 'medium' FROM {_of('competitive_to_sole_source')}
  UNION ALL SELECT DISTINCT normalized_vendor, 'threshold_splitting', 'medium' FROM {_of('threshold_splitting')} UNION ALL SELECT DISTINCT entity_name, 'adverse_media', 'high' FROM {_of('adverse_media_matches')}
  UNION ALL SELECT name, 'many_departments', 'low' FROM {_of('duplicative_funding')} WHERE dept_count >= 4""")(screen)  # fmt: skip


@view("headline_findings", "finding:s n:l amount:d", _ALL, f"""
  SELECT 'ceased' AS finding, count(*) AS n, CAST(sum(grants_3yr_pre_fpe) AS DOUBLE) AS amount FROM {_of('zombie_recipients')} WHERE cohort = 'cessation' UNION ALL SELECT 'turned_sole_source', count(*), CAST(sum(max_effective_value) AS DOUBLE) FROM {_of('competitive_to_sole_source')}
  UNION ALL SELECT 'several_departments', count(*), CAST(sum(total_value) AS DOUBLE) FROM {_of('duplicative_funding')} UNION ALL SELECT 'transfers', count(*), CAST(sum(total_gifts) AS DOUBLE) FROM transfers""")  # fmt: skip
def headline_findings(t):
    """The counts and sums that head a report, a row each."""
    tops = [
        zombie_recipients(t).where("cohort = 'cessation'").agg(F.count("*").alias("n"), F.sum("grants_3yr_pre_fpe").cast("double").alias("amount")).withColumn("finding", F.lit("ceased")),
        competitive_to_sole_source(t).agg(F.count("*").alias("n"), F.sum("max_effective_value").cast("double").alias("amount")).withColumn("finding", F.lit("turned_sole_source")),
        duplicative_funding(t).agg(F.count("*").alias("n"), F.sum("total_value").cast("double").alias("amount")).withColumn("finding", F.lit("several_departments")),
        funding_stats(t).select(F.col("total_transfers").alias("n"), F.col("total_amount").cast("double").alias("amount"), F.lit("transfers").alias("finding")),
    ]
    return reduce(DataFrame.unionByName, tops)


@view("briefing", "topic:s entity:s amount:d", _ALL, f"""
  SELECT * FROM (SELECT 'ceased' AS topic, legal_name AS entity, CAST(grants_3yr_pre_fpe AS DOUBLE) AS amount FROM {_of('zombie_recipients')} WHERE cohort = 'cessation' ORDER BY grants_3yr_pre_fpe DESC, bn LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 'concentration', norm_vendor, CAST(total_value AS DOUBLE) FROM {_of('vendor_concentration')} ORDER BY total_value DESC, norm_vendor LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 'overlap', name, CAST(total_value AS DOUBLE) FROM {_of('duplicative_funding')} ORDER BY dept_count DESC, total_value DESC, uname LIMIT 1)""")  # fmt: skip
def briefing(t):
    """The first finding of each of three views; top-1s, not sorts."""
    return reduce(DataFrame.unionByName, [
        top_k(zombie_recipients(t).where("cohort = 'cessation'"), [F.desc("grants_3yr_pre_fpe"), F.asc("bn")], 1).select(F.lit("ceased").alias("topic"), F.col("legal_name").alias("entity"), F.col("grants_3yr_pre_fpe").cast("double").alias("amount")),
        top_k(vendor_concentration(t), [F.desc("total_value"), F.asc("norm_vendor")], 1).select(F.lit("concentration").alias("topic"), F.col("norm_vendor").alias("entity"), F.col("total_value").cast("double").alias("amount")),
        top_k(duplicative_funding(t), [F.desc("dept_count"), F.desc("total_value"), F.asc("uname")], 1).select(F.lit("overlap").alias("topic"), F.col("name").alias("entity"), F.col("total_value").cast("double").alias("amount")),
    ])


@view("coverage", "grants_with_bn_pct:d contracts_amended_pct:d", "grants contracts", """
  SELECT (SELECT 100.0 * count(recipient_business_number) / count(*) FROM grants) AS grants_with_bn_pct, (SELECT 100.0 * count(*) FILTER (amendment_value > 0) / count(*) FROM contracts) AS contracts_amended_pct""")  # fmt: skip
def coverage(t):
    g = t["grants"].agg((ratio(F.count("recipient_business_number").cast("double"), F.count("*").cast("double")) * 100).alias("grants_with_bn_pct"))
    return g.crossJoin(t["contracts"].agg((ratio(F.count_if(F.col("amendment_value") > 0).cast("double"), F.count("*").cast("double")) * 100).alias("contracts_amended_pct")))  # a row each
