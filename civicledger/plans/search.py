"""Searches a user types: full text over records and texts, a page with its total and facets from one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import same_letters
from ..operators import fulltext
from .registry import view


def _index_sql(rows: str) -> str:
    """CTEs l (key, length, place, term), p (term, key, length, n) and s (docs, total) over rows of (key, text)."""
    return rf"""r AS ({rows}), w AS (SELECT key, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS words FROM r), l AS (SELECT key, len(words) AS length, unnest(words) AS term, generate_subscripts(words, 1) AS place FROM w),
  p AS (SELECT term, key, length, count(*) AS n FROM l GROUP BY ALL), s AS (SELECT count(*) AS docs, sum(len(words)) AS total FROM w)"""


def _score_sql(words: list[str]) -> str:
    """CTE q (key, score): BM25 over the words."""
    listed = ", ".join(f"'{w}'" for w in words)
    return f"""h AS (SELECT term, count(*) AS df FROM p WHERE term IN ({listed}) GROUP BY 1),
  q AS (SELECT key, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * (n * CAST(2.2 AS DOUBLE) / (n + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * length * docs / total)))) AS score FROM p JOIN h USING (term), s GROUP BY key)"""


_GRANT_TEXT = "concat_ws(' ', recipient_legal_name, owner_org_title, prog_name_en, description_en)"


@view("grants_fulltext", "key:l score:d", "grants", f"""
  WITH {_index_sql(f'SELECT id AS key, {_GRANT_TEXT} AS text FROM grants')}, {_score_sql(['housing', 'climate', 'support', 'for', 'machinery'])}
  SELECT key, score FROM q WHERE key IN (SELECT key FROM p WHERE term IN ('housing', 'climate')) AND key IN (SELECT key FROM p WHERE term = 'machinery')
    AND key IN (SELECT a.key FROM l a JOIN l b ON a.key = b.key AND b.place = a.place + 1 WHERE a.term = 'support' AND b.term = 'for')""")  # fmt: skip
def grants_fulltext(t, q: str = 'housing OR climate "support for" machinery'):
    """Grants by words of their recipient, department, program and description."""
    own = fulltext.index(t["grants"], "id", "recipient_legal_name", "owner_org_title", "prog_name_en", "description_en")
    return fulltext.search(own, fulltext.request(q))


@view("documents_fulltext", "key:l score:d", "", f"""
  WITH {_index_sql('SELECT doc_id AS key, text FROM documents')}, {_score_sql(['of', 'the', 'with', 'und', 'der'])},
  h2 AS (SELECT DISTINCT a.key FROM l a JOIN l b ON a.key = b.key AND b.place = a.place + 1 WHERE a.term = 'of' AND b.term = 'the'), h3 AS (SELECT DISTINCT a.key FROM l a JOIN l b ON a.key = b.key AND b.place = a.place + 1 WHERE a.term = 'und' AND b.term = 'der')
  SELECT key, score FROM q WHERE key IN (SELECT key FROM h2 UNION SELECT key FROM h3) AND key IN (SELECT key FROM p WHERE term IN ('with', 'und'))""")  # fmt: skip
def documents_fulltext(t, q: str = '"of the" OR "und der" with OR und'):
    """Texts that hold one of two phrases and one of two words, over whole texts."""
    return fulltext.search(fulltext.index(t.raw("documents"), "doc_id", "text"), fulltext.request(q))


# What users call the catalog's filters.
FILTERS = {
    "organization": "owner_org", "org": "owner_org", "publisher": "owner_org", "portal type": "dataset_type", "dataset type": "dataset_type", "type of dataset": "dataset_type",
    "collection": "collection", "collection type": "collection", "jurisdiction": "jurisdiction", "keywords": "keywords_en", "keyword": "keywords_en", "subject": "subject_en",
    "format": "resource_format", "formats": "resource_format", "update frequency": "frequency", "frequency": "frequency", "resource type": "resource_type", "api enabled": "datastore_enabled", "datastore enabled": "datastore_enabled",
}


def filter_name(said: str, headings: dict[str, str] | None = None) -> str | None:
    """The filter that a user means: by what it is called, by its own name, or by its heading (name -> heading)."""
    plain = lambda x: "".join(c for c in x.lower() if c.isascii() and c.isalnum())
    known = {plain(k): v for k, v in FILTERS.items()} | {plain(v): v for v in FILTERS.values()}
    return known.get(plain(said)) or {plain(h): name for name, h in (headings or {}).items()}.get(plain(said))


def resolve(options: DataFrame, asked: DataFrame) -> DataFrame:
    """(filter, said, how, value, candidates): what each asked (filter, said) means among options (filter, value, label).

    An equal value or label (in letters and digits, ties to the least value), else the only one that begins so, else
    the only one that has it inside; else none, and `candidates` says how many were in question. Options are laid out
    once as a table of keys by filter; beginnings are a range of it, so that a sorted table is searched and not read.
    """
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    table = options.select("filter", "value", F.explode(F.array_distinct(F.array(key(F.col("value")), key(F.col("label"))))).alias("key")).where("key <> ''")
    want = asked.select("filter", "said", key(F.col("said")).alias("wanted"))
    inside = (table["filter"] == want["filter"]) & table["key"].contains(F.col("wanted"))
    met = want.join(table, inside).select(want["filter"], "said", "value", "key", "wanted")
    begins = (F.col("key") >= F.col("wanted")) & (F.col("key") < F.concat("wanted", F.lit("\x7f")))
    by = met.where("wanted <> ''").groupBy("filter", "said").agg(
        F.min(F.when(F.col("key") == F.col("wanted"), F.col("value"))).alias("equal"),
        F.count_distinct(F.when(begins, F.col("value"))).alias("n_begin"), F.min(F.when(begins, F.col("value"))).alias("begin"),
        F.count_distinct("value").alias("n_inside"), F.min("value").alias("inside"),
    )
    only = F.when(F.col("equal").isNotNull(), F.struct(F.lit("equal").alias("how"), F.col("equal").alias("value")))
    only = only.when(F.col("n_begin") == 1, F.struct(F.lit("begins").alias("how"), F.col("begin").alias("value"))).when(F.col("n_inside") == 1, F.struct(F.lit("inside").alias("how"), F.col("inside").alias("value")))
    out = asked.select("filter", "said").join(by.withColumn("x", only), ["filter", "said"], "left")
    return out.select("filter", "said", F.coalesce("x.how", F.lit("none")).alias("how"), "x.value", F.coalesce("n_inside", F.lit(0)).alias("candidates"))


_OPTIONS = "SELECT DISTINCT 'brand' AS filter, p_brand AS value, 'The ' || p_brand AS label FROM part UNION ALL SELECT DISTINCT 'priority', o_orderpriority, substr(o_orderpriority, 3) FROM orders UNION ALL SELECT 'nation', n_name, n_name FROM nation"
_ASKED = [("brand", "brand#1"), ("brand", "Brand 2"), ("brand", "the brand#25"), ("brand", "nothing"), ("priority", "urg"), ("priority", "not-specified"), ("priority", "e"), ("nation", "nation_1"), ("nation", "NATION 24"), ("nation", "_24"), ("nation", "")]


@view("resolved_filters", "filter:s said:s how:s value:s candidates:l", "", f"""
  WITH o AS ({_OPTIONS}), k AS (SELECT DISTINCT filter, value, unnest([regexp_replace(lower(value), '[^a-z0-9]+', '', 'g'), regexp_replace(lower(label), '[^a-z0-9]+', '', 'g')]) AS key FROM o),
  a AS (SELECT *, regexp_replace(lower(said), '[^a-z0-9]+', '', 'g') AS wanted FROM (VALUES {', '.join(str(x) for x in _ASKED)}) v(filter, said)),
  m AS (SELECT a.filter, said, min(value) FILTER (key = wanted) AS e, count(DISTINCT value) FILTER (starts_with(key, wanted)) AS nb, min(value) FILTER (starts_with(key, wanted)) AS b, count(DISTINCT value) AS ni, min(value) AS i FROM a JOIN k ON a.filter = k.filter AND contains(key, wanted) WHERE wanted <> '' GROUP BY ALL)
  SELECT a.filter, a.said, CASE WHEN e IS NOT NULL THEN 'equal' WHEN nb = 1 THEN 'begins' WHEN ni = 1 THEN 'inside' ELSE 'none' END AS how, CASE WHEN e IS NOT NULL THEN e WHEN nb = 1 THEN b WHEN ni = 1 THEN i END AS value, coalesce(ni, 0) AS candidates
  FROM a LEFT JOIN m ON a.filter = m.filter AND a.said = m.said""")  # fmt: skip
def resolved_filters(t):
    """What eleven stated inputs mean among the values of three filters."""
    options = t.spark.sql(_OPTIONS.replace("FROM part", "FROM {part}").replace("FROM orders", "FROM {orders}").replace("FROM nation", "FROM {nation}"), part=t.raw("part"), orders=t.raw("orders"), nation=t.raw("nation"))
    return resolve(options, F.broadcast(t.spark.createDataFrame(_ASKED, "filter string, said string")))


@view("recipients_by_letters", "name:s spellings:l grants:l total_value:d", "", """
  SELECT lower(strip_accents(name)) AS name, count(DISTINCT name) AS spellings, count(*) AS grants, sum(v) AS total_value FROM (
    SELECT CASE o_orderkey % 4 WHEN 0 THEN n_name || ' école' WHEN 1 THEN upper(n_name) || ' ECOLE' WHEN 2 THEN lower(n_name) || ' Ecôle' ELSE n_name || ' éco' || 'le' END AS name, CAST(o_totalprice AS DECIMAL(18, 2)) AS v
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1""")  # fmt: skip
def recipients_by_letters(t):
    """Names that differ in case and accents only, grouped by a collation's key."""
    o = t.raw("orders").join(t.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("o_orderkey") % 4
    name = F.when(k == 0, F.concat("n_name", F.lit(" école"))).when(k == 1, F.concat(F.upper("n_name"), F.lit(" ECOLE"))).when(k == 2, F.concat(F.lower("n_name"), F.lit(" Ecôle"))).otherwise(F.concat("n_name", F.lit(" éco"), F.lit("le")))
    rows = o.select(name.alias("spelling"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    by = rows.groupBy(same_letters(F.col("spelling")).alias("letters")).agg(F.count_distinct("spelling").alias("spellings"), F.count("*").alias("grants"), F.sum("v").alias("total_value"), F.first("spelling").alias("s"))
    return by.withColumn("name", F.lower(F.translate("s", "éôÉÔ", "eoEO")))


def page_with_total(rows: DataFrame, order: list, limit: int, offset: int = 0, facets: dict[str, list] | None = None) -> dict:
    """{records, total, facets}: a page of `rows`, how many there are, and how many have each stated value.

    Total and counts are metrics that the page's own scan observes on its way to the top-k; nothing is read twice.
    """
    from pyspark.sql import Observation

    seen = Observation()
    stated = [(c, v) for c, values in (facets or {}).items() for v in values]
    counts = [F.count_if(F.col(c).eqNullSafe(F.lit(v))).alias(f"f{i}") for i, (c, v) in enumerate(stated)]
    records = rows.observe(seen, F.count(F.lit(1)).alias("total"), *counts).orderBy(*order).offset(offset).limit(limit).collect()
    got = seen.get
    out: dict = {c: {} for c in facets or {}}
    for i, (c, v) in enumerate(stated):
        out[c][v] = got[f"f{i}"]
    return {"records": records, "total": got["total"], "limit": limit, "offset": offset, "facets": out}


def datastore_search(rows: DataFrame, key: str, q: str | None = None, filters: dict | None = None, fields: list[str] | None = None, sort: str | None = None, limit: int = 10, offset: int = 0) -> dict:
    """{fields, records, total, limit, offset} of a resource with a unique `key`.

    filters: column -> value or values; q: words and "phrases" that any column of text holds; sort: columns of the
    resource, each with asc or desc, nulls last; without it by rank where there is a q, and ties by key.
    """
    kinds = dict(rows.dtypes)
    for c in [*(filters or {}), *(fields or [])]:
        if c not in kinds:
            raise ValueError(f"there is no field {c}")
    order = []
    for part in filter(None, (x.split() for x in (sort or "").split(","))):
        if part[0] not in kinds or part[1:] not in ([], ["asc"], ["desc"]):
            raise ValueError(f"can't sort by {' '.join(part)}")
        order.append(F.col(part[0]).desc_nulls_last() if part[1:] == ["desc"] else F.col(part[0]).asc_nulls_last())
    for c, value in (filters or {}).items():
        rows = rows.where(F.col(c).isin(value) if isinstance(value, list) else F.col(c) == F.lit(value))
    if q:
        texts = [c for c, kind in kinds.items() if kind == "string" and c != key]
        found = fulltext.search(fulltext.index(rows, key, *texts), fulltext.request(q))
        rows = rows.join(found.select(F.col("key").alias(key), F.col("score").alias("_rank")), key)
        order = order or [F.round("_rank", 9).desc()]
    shown = fields or [c for c in kinds]
    got = page_with_total(rows, [*order, F.col(key)], limit, offset)
    records = [{c: r[c] for c in shown} for r in got["records"]]
    return {"fields": [{"id": c, "type": kinds[c]} for c in shown], "records": records, "total": got["total"], "limit": limit, "offset": offset}
