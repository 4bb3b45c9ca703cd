"""Views over transfers and directors: loops, boards, governance flows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import bn_prefix, person_key
from ..operators import graph
from ..operators import relational as rel
from .domain import contracts_of
from .registry import view

AS_OF = "2022-01-01"
LEAST_GIFT = 100_000
# Names of federated bodies, between which money moves by design.
HIERARCHY = "diocese|archdiocese|synod|province of|federation of|conference of|congregation of|presbytery|eparchy"
PLATFORM = r"benevity|canadahelps|united way|united jewish appeal|jewish federation|jewish community foundation|community foundation of|catholic charities|y\s?m\s?c\s?a|ywca"


def names_by_prefix(charities: DataFrame) -> DataFrame:
    """(bn_prefix, legal_name), one row for each prefix, a named one if there is one, ties to the least name."""
    return charities.groupBy(bn_prefix(F.col("bn")).alias("bn_prefix")).agg(F.min("legal_name").alias("legal_name"))


def _edges(transfers: DataFrame, least: float | None = None) -> DataFrame:
    rows = transfers.where("donor_bn IS NOT NULL AND donee_bn IS NOT NULL")
    rows = rows if least is None else rows.where(F.col("total_gifts") >= least)
    return rows.groupBy(F.col("donor_bn").alias("src"), F.col("donee_bn").alias("dst")).agg(F.sum("total_gifts").alias("amount"))


def _named(loops: DataFrame, t, nodes: int) -> DataFrame:
    """Add name_i for each node n_i; a node without a charity is called by its number."""
    names = names_by_prefix(t["charities"])
    for i in range(nodes):
        other = names.select(F.col("bn_prefix").alias("_p"), F.col("legal_name").alias("_n"))
        loops = loops.join(other, bn_prefix(F.col(f"n{i}")) == F.col("_p"), "left").withColumn(f"name_{i}", F.coalesce("_n", f"n{i}")).drop("_p", "_n")
    return loops


def _letters(loops: DataFrame, nodes: int) -> DataFrame:
    """The published column names: bn_a, name_a, a_to_b, .."""
    abc = "abcd"[:nodes]
    cols = [F.col(f"n{i}").alias(f"bn_{x}") for i, x in enumerate(abc)] + [F.col(f"name_{i}").alias(f"name_{x}") for i, x in enumerate(abc)]
    legs = [F.col(f"leg{i}").alias(f"{x}_to_{abc[(i + 1) % nodes]}") for i, x in enumerate(abc)]
    return loops.select(*cols, *legs, "min_leg", "total_circled")


_E = "SELECT donor_bn AS src, donee_bn AS dst, sum(total_gifts) AS amt FROM transfers WHERE {} GROUP BY ALL"
_NAMES = "SELECT substr(bn, 1, 9) AS p, min(legal_name) AS nm FROM charities GROUP BY 1"


def _cycle_sql(n: int) -> str:
    a = "abcd"[:n]
    joins = " ".join(f"JOIN e {a[i]}{a[(i + 1) % n]} ON {a[i - 1]}{a[i]}.dst = {a[i]}{a[(i + 1) % n]}.src" for i in range(1, n))
    differ = " AND ".join(f"{x}{a[(i + 1) % n]}.src <> {y}{a[(j + 1) % n]}.src" for i, x in enumerate(a) for j, y in enumerate(a) if i < j)
    least = " AND ".join(f"ab.src < {x}{a[(i + 1) % n]}.src" for i, x in enumerate(a) if i)
    legs = [f"{x}{a[(i + 1) % n]}.amt" for i, x in enumerate(a)]
    cols = ", ".join([f"{x}{a[(i + 1) % n]}.src AS bn_{x}" for i, x in enumerate(a)] + [f"coalesce((SELECT nm FROM nm WHERE p = substr({x}{a[(i + 1) % n]}.src, 1, 9)), {x}{a[(i + 1) % n]}.src) AS name_{x}" for i, x in enumerate(a)] + [f"{leg} AS {x}_to_{a[(i + 1) % n]}" for i, (x, leg) in enumerate(zip(a, legs, strict=True))])
    return f"""WITH e AS ({_E.format(f'total_gifts >= {LEAST_GIFT}')}), nm AS ({_NAMES}) SELECT {cols}, least({', '.join(legs)}) AS min_leg, {' + '.join(legs)} AS total_circled FROM e ab {joins} AND {a[-1]}a.dst = ab.src WHERE {differ} AND {least}"""


@view("funding_stats", "total_transfers:l total_amount:d unique_donors:l unique_donees:l", "transfers", "SELECT count(*) AS total_transfers, sum(total_gifts) AS total_amount, count(DISTINCT donor_bn) AS unique_donors, count(DISTINCT donee_bn) AS unique_donees FROM transfers")
def funding_stats(t):
    return t["transfers"].agg(F.count("*").alias("total_transfers"), F.coalesce(F.sum("total_gifts"), F.lit(0)).alias("total_amount"), F.count_distinct("donor_bn").alias("unique_donors"), F.count_distinct("donee_bn").alias("unique_donees"))


_RECIPROCAL = f"""WITH e AS ({_E.format('TRUE')}), nm AS ({_NAMES}) SELECT a.src AS donor_bn, a.dst AS donee_bn, coalesce(x.nm, a.src) AS donor_name, coalesce(y.nm, a.dst) AS donee_name, a.amt AS a_to_b, b.amt AS b_to_a
  FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src LEFT JOIN nm x ON x.p = substr(a.src, 1, 9) LEFT JOIN nm y ON y.p = substr(a.dst, 1, 9) WHERE a.src < a.dst AND a.amt > 0 AND b.amt > 0"""


@view("funding_reciprocals", "donor_bn:s donee_bn:s donor_name:s donee_name:s a_to_b:d b_to_a:d", "transfers charities", _RECIPROCAL)
def funding_reciprocals(t):
    """Pairs of different entities that give to each other, once each."""
    both = graph.reciprocal(_edges(t["transfers"]).where("amount > 0")).where(bn_prefix(F.col("n0")) != bn_prefix(F.col("n1")))
    return _named(both, t, 2).select(F.col("n0").alias("donor_bn"), F.col("n1").alias("donee_bn"), F.col("name_0").alias("donor_name"), F.col("name_1").alias("donee_name"), F.col("leg0").alias("a_to_b"), F.col("leg1").alias("b_to_a"))


def _loops(t, nodes: int) -> DataFrame:
    """Cycles over gifts of LEAST_GIFT and more (each gift, as the sums' floor), of entities with different prefixes."""
    found = graph.cycles(_edges(t["transfers"], LEAST_GIFT), nodes)
    prefixes = F.array(*[bn_prefix(F.col(f"n{i}")) for i in range(nodes)])
    return found.where(F.size(F.array_distinct(prefixes)) == nodes)


@view("funding_triangles", "bn_a:s bn_b:s bn_c:s name_a:s name_b:s name_c:s a_to_b:d b_to_c:d c_to_a:d min_leg:d total_circled:d", "transfers charities", _cycle_sql(3))
def funding_triangles(t):
    return _letters(_named(_loops(t, 3), t, 3), 3)


@view("funding_chains_4", "bn_a:s bn_b:s bn_c:s bn_d:s a_to_b:d b_to_c:d c_to_d:d d_to_a:d min_leg:d total_circled:d", "transfers charities", _cycle_sql(4) + " ORDER BY total_circled DESC, bn_a, bn_b, bn_c LIMIT 1000")
def funding_chains_4(t):
    """The 1000 cycles of four entities that move most; names are looked up for those only."""
    top = rel.top_k(_loops(t, 4), [F.desc("total_circled"), F.asc("n0"), F.asc("n1"), F.asc("n2")], 1000)
    return _letters(_named(top, t, 4), 4)


def _class_sql(kind: str, n: int, source: str, total: str) -> str:
    a = "abcd"[:n]
    bns, names = ("donor_bn, donee_bn", "donor_name, donee_name") if kind == "reciprocal" else (", ".join(f"bn_{x}" for x in a), ", ".join(f"name_{x}" for x in a))
    return f"SELECT '{kind}' AS loop_type, [{bns}] AS bns, lower(array_to_string([{names}], chr(10))) AS nm, {total} AS total_circled FROM ({source})"


_LOOPS_SQL = " UNION ALL ".join([_class_sql("reciprocal", 2, _RECIPROCAL, "a_to_b + b_to_a"), _class_sql("triangle", 3, _cycle_sql(3), "total_circled"), _class_sql("chain4", 4, _cycle_sql(4) + " ORDER BY total_circled DESC, bn_a, bn_b, bn_c LIMIT 1000", "total_circled")])
_CLASSIFIED = f"""SELECT loop_type, bns, total_circled, CASE WHEN regexp_matches(nm, '{HIERARCHY}') THEN 'structural_hierarchy' WHEN regexp_matches(nm, '{PLATFORM}') THEN 'structural_platform'
  WHEN loop_type = 'reciprocal' THEN 'reciprocal_pair' ELSE 'possible_suspicious' END AS classification FROM ({_LOOPS_SQL})"""


@view("funding_loop_classification", "loop_type:s bns:a total_circled:d classification:s", "transfers charities", _CLASSIFIED)
def funding_loop_classification(t):
    """All loops in one shape, labelled by the names of their members; candidates, not findings."""
    shapes = [
        funding_reciprocals(t).select(F.lit("reciprocal").alias("loop_type"), F.array("donor_bn", "donee_bn").alias("bns"), F.array("donor_name", "donee_name").alias("names"), (F.col("a_to_b") + F.col("b_to_a")).alias("total_circled")),
        *[df.select(F.lit(kind).alias("loop_type"), F.array(*[f"bn_{x}" for x in a]).alias("bns"), F.array(*[f"name_{x}" for x in a]).alias("names"), "total_circled") for kind, a, df in (("triangle", "abc", funding_triangles(t)), ("chain4", "abcd", funding_chains_4(t)))],
    ]
    named = lambda words: F.exists("names", lambda n: F.lower(n).rlike(words))
    label = F.when(named(HIERARCHY), "structural_hierarchy").when(named(PLATFORM), "structural_platform").when(F.col("loop_type") == "reciprocal", "reciprocal_pair").otherwise("possible_suspicious")
    return reduce(DataFrame.unionByName, shapes).withColumn("classification", label)


@view("loop_counts", "classification:s loop_type:s n:l", "transfers charities", f"SELECT classification, loop_type, count(*) AS n FROM ({_CLASSIFIED}) GROUP BY ALL")
def loop_counts(t):
    return funding_loop_classification(t).groupBy("classification", "loop_type").agg(F.count("*").alias("n"))


@view("funding_top_transfers", "donor_bn:s donor_name:s donee_name:s donee_bn:s total_gifts:d province:s", "transfers charities", """
  SELECT donor_bn, coalesce(legal_name, donor_bn) AS donor_name, donee_name, donee_bn, total_gifts, province FROM (SELECT * FROM transfers WHERE total_gifts > 0 ORDER BY total_gifts DESC, donor_bn, donee_bn LIMIT 25) LEFT JOIN charities ON donor_bn = bn""")  # fmt: skip
def funding_top_transfers(t):
    top = rel.top_k(t["transfers"].where("total_gifts > 0"), [F.desc("total_gifts"), F.asc("donor_bn"), F.asc("donee_bn")], 25)
    return top.join(t["charities"].select(F.col("bn").alias("donor_bn"), "legal_name"), "donor_bn", "left").withColumn("donor_name", F.coalesce("legal_name", "donor_bn"))


_BEST = "SELECT donor_bn AS src, donee_bn AS dst, sum(total_gifts) AS amount FROM transfers WHERE donor_bn IS NOT NULL AND donee_bn IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY donor_bn ORDER BY sum(total_gifts) DESC, donee_bn) = 1"


@view("largest_edge_walk", "start:s hop:l src:s dst:s amount:d", "transfers", f"""
  WITH RECURSIVE e AS ({_BEST}), w AS (
    SELECT s.node AS start, 1 AS hop, src, dst, amount, [s.node] AS seen FROM (SELECT DISTINCT donor_bn AS node FROM transfers WHERE donor_bn IS NOT NULL) s JOIN e ON e.src = s.node
    UNION ALL SELECT start, hop + 1, e.src, e.dst, e.amount, list_append(seen, w.dst) FROM w JOIN e ON e.src = w.dst WHERE hop < 3 AND NOT list_contains(seen, w.dst))
  SELECT start, hop, src, dst, amount FROM w""")  # fmt: skip
def largest_edge_walk(t):
    """From every donor, three steps along the largest transfer."""
    starts = t["transfers"].select(F.col("donor_bn").alias("node")).where("node IS NOT NULL").distinct()
    return graph.largest_edge_walk(_edges(t["transfers"]), starts, hops=3)


_LINKS = f"""SELECT lower(trim(first_name)) || '|' || lower(trim(last_name)) || '|' || coalesce(upper(trim(initials)), '') AS person_key, substr(d.bn, 1, 9) AS bn_prefix,
    coalesce(any_value(nm), substr(d.bn, 1, 9)) AS charity_name, min(position) AS role, bool_or(coalesce(trim(initials), '') <> '') AS disambiguated
  FROM directors d LEFT JOIN (SELECT substr(bn, 1, 9) AS p, max(fpe) AS fpe FROM financial GROUP BY 1) f ON f.p = substr(d.bn, 1, 9) LEFT JOIN ({_NAMES}) n ON n.p = substr(d.bn, 1, 9)
  WHERE trim(first_name) <> '' AND trim(last_name) <> '' AND (end_date IS NULL OR end_date > DATE '{AS_OF}' - INTERVAL 12 MONTH) AND (fpe IS NULL OR fpe >= DATE '{AS_OF}' - INTERVAL 24 MONTH) GROUP BY 1, 2"""


def _sitting(t, as_of: str = AS_OF) -> DataFrame:
    """(person_key, bn_prefix, position, _sure): director rows not ended a year ago or earlier, at charities that filed in
    the last two years. Who filed is asked before rows are grouped, by the key that a charity's other tables have."""
    day = F.lit(as_of).cast("date")
    filed = t["financial"].groupBy(bn_prefix(F.col("bn")).alias("bn_prefix")).agg(F.max("fpe").alias("_fpe"))
    d = t["directors"].where((F.trim("first_name") != "") & (F.trim("last_name") != "") & (F.col("end_date").isNull() | (F.col("end_date") > F.add_months(day, -12))))
    d = d.select(person_key(F.col("first_name"), F.col("last_name"), F.col("initials")).alias("person_key"), bn_prefix(F.col("bn")).alias("bn_prefix"), "position", (F.coalesce(F.trim("initials"), F.lit("")) != "").alias("_sure"))
    return d.join(filed, "bn_prefix", "left").where(F.col("_fpe").isNull() | (F.col("_fpe") >= F.add_months(day, -24))).drop("_fpe")


@view("director_board_links", "person_key:s bn_prefix:s charity_name:s role:s disambiguated:b", "directors financial charities", _LINKS)
def director_board_links(t, as_of: str = AS_OF):
    """Who sits on which board now: not ended a year ago or earlier, at charities that filed in the last two years."""
    one = _sitting(t, as_of).groupBy("person_key", "bn_prefix").agg(F.min("position").alias("role"), F.bool_or("_sure").alias("disambiguated"))
    return one.join(names_by_prefix(t["charities"]), "bn_prefix", "left").withColumn("charity_name", F.coalesce("legal_name", "bn_prefix")).drop("legal_name")


_MULTI = f"SELECT person_key, list_sort(list(DISTINCT bn_prefix)) AS bn_prefixes, list_sort(list(DISTINCT charity_name)) AS charities, count(DISTINCT bn_prefix) AS board_count, bool_and(disambiguated) AS disambiguated FROM ({_LINKS}) GROUP BY 1 HAVING count(DISTINCT bn_prefix) >= 2"


@view("director_multi_board", "person_key:s bn_prefixes:a charities:a board_count:l disambiguated:b", "directors financial charities", _MULTI)
def director_multi_board(t):
    """People on two boards or more; where initials are missing the key may be several people."""
    links = director_board_links(t).groupBy("person_key").agg(F.array_sort(F.collect_set("bn_prefix")).alias("bn_prefixes"), F.array_sort(F.collect_set("charity_name")).alias("charities"), F.bool_and("disambiguated").alias("disambiguated"))
    return links.withColumn("board_count", F.size("bn_prefixes")).where("board_count >= 2")


_FLOWS = f"""
  WITH l AS ({_LINKS}), x AS (SELECT substr(donor_bn, 1, 9) AS a, substr(donee_bn, 1, 9) AS b, sum(total_gifts) AS amt FROM transfers WHERE total_gifts > 0 GROUP BY ALL), nm AS ({_NAMES}),
  g AS (SELECT substr(recipient_business_number, 1, 9) AS p, count(*) AS n, sum(agreement_value) AS v FROM grants WHERE length(recipient_business_number) >= 9 AND agreement_value > 0 GROUP BY 1),
  c AS (SELECT lower(normalized_vendor) AS v, sum(effective_value) AS amt FROM contracts WHERE effective_value > 0 GROUP BY 1)
  SELECT p.*, coalesce(nx.nm, bn_x) AS name_x, coalesce(ny.nm, bn_y) AS name_y, coalesce(x1.amt, 0) AS transfer_xy, coalesce(x2.amt, 0) AS transfer_yx,
         CASE WHEN gx.n IS NULL OR gy.n IS NULL THEN 0 ELSE gx.n + gy.n END AS joint_grants_count, CASE WHEN gx.n IS NULL OR gy.n IS NULL THEN 0 ELSE gx.v + gy.v END AS joint_grants_value,
         coalesce(cx.amt, 0) + coalesce(cy.amt, 0) AS shared_contract_value, coalesce(x1.amt, 0) + coalesce(x2.amt, 0) + 0.5 * CASE WHEN gx.n IS NULL OR gy.n IS NULL THEN 0 ELSE gx.v + gy.v END AS rank_score
  FROM (SELECT a.person_key, a.bn_prefix AS bn_x, b.bn_prefix AS bn_y, a.disambiguated AND b.disambiguated AS disambiguated FROM l a JOIN l b ON a.person_key = b.person_key AND a.bn_prefix < b.bn_prefix) p
  LEFT JOIN nm nx ON nx.p = bn_x LEFT JOIN nm ny ON ny.p = bn_y LEFT JOIN x x1 ON x1.a = bn_x AND x1.b = bn_y LEFT JOIN x x2 ON x2.a = bn_y AND x2.b = bn_x LEFT JOIN g gx ON gx.p = bn_x LEFT JOIN g gy ON gy.p = bn_y
  LEFT JOIN c cx ON cx.v = lower(nx.nm) LEFT JOIN c cy ON cy.v = lower(ny.nm)"""


@view("governance_flow_links", "person_key:s bn_x:s bn_y:s name_x:s name_y:s disambiguated:b transfer_xy:d transfer_yx:d joint_grants_count:l joint_grants_value:d shared_contract_value:d rank_score:d", "directors financial charities transfers grants contracts", _FLOWS)
def governance_flow_links(t, about: list[str] | None = None, contracts: bool = True):
    """Pairs of charities that share a director, with the money between and around them.

    The pairs are those of one person's boards: for a name that many people share, the square of its boards. What only
    asks whether or how many pairs there are goes by transfers_within() and doesn't make them; with `about` only the
    pairs of people on one of these boards are made. Without `contracts` what the two sold isn't looked up.

    What is known of a charity comes to its boards, by the key that tells whether it filed, and not to each side of the
    pairs; pairs meet the transfers once, summed up for both ways. Contracts that no charity's name sold are left out
    before orders and parts are joined to them.
    """
    granted = t["grants"].where((F.col("agreement_value") > 0) & (F.length("recipient_business_number") >= 9)).groupBy(bn_prefix(F.col("recipient_business_number")).alias("bn_prefix")).agg(F.count("*").alias("_n"), F.sum("agreement_value").alias("_v"))
    names = names_by_prefix(t["charities"])
    if contracts:
        sold = contracts_of(t, names.select(F.lower("legal_name").alias("vendor")))
        bought = sold.where("effective_value > 0 AND normalized_vendor IS NOT NULL").groupBy(F.lower("normalized_vendor").alias("_vendor")).agg(F.sum("effective_value").alias("_c"))
        names = names.join(bought, F.lower("legal_name") == F.col("_vendor"), "left").drop("_vendor")
    else:
        names = names.withColumn("_c", F.lit(None).cast("decimal(18,2)"))
    known = ["legal_name", "_n", "_v", "_c"]
    sitting = _sitting(t).join(names, "bn_prefix", "left").join(granted, "bn_prefix", "left")
    links = sitting.groupBy("person_key", "bn_prefix", *known).agg(F.bool_or("_sure").alias("_sure"))
    if about is not None:
        links = links.join(_sitting(t).where(F.col("bn_prefix").isin(about)).select("person_key").distinct(), "person_key", "left_semi")
    side = lambda z: links.select("person_key", *[F.col(c).alias(f"{c}_{z}") for c in ("bn_prefix", "_sure", *known)])
    pairs = side("x").join(side("y"), "person_key").where("bn_prefix_x < bn_prefix_y").withColumnsRenamed({"bn_prefix_x": "bn_x", "bn_prefix_y": "bn_y"})
    # prefixes are made once for each row, so they are columns of their own; what has one end or equal ends meets no pair
    gifts, a, b = F.col("total_gifts"), F.col("_a"), F.col("_b")
    moved = t["transfers"].where(gifts > 0).select(bn_prefix(F.col("donor_bn")).alias("_a"), bn_prefix(F.col("donee_bn")).alias("_b"), gifts)
    moved = moved.select(F.coalesce(F.least(a, b), F.lit("")).alias("bn_x"), F.coalesce(F.greatest(a, b), F.lit("")).alias("bn_y"), F.when(a < b, gifts).alias("_xy"), F.when(a > b, gifts).alias("_yx"))
    moved = moved.groupBy("bn_x", "bn_y").agg(F.sum("_xy").alias("_xy"), F.sum("_yx").alias("_yx"))
    pairs = pairs.join(moved, ["bn_x", "bn_y"], "left")
    both = F.col("_n_x").isNotNull() & F.col("_n_y").isNotNull()
    pairs = pairs.withColumns({
        "name_x": F.coalesce("legal_name_x", "bn_x"), "name_y": F.coalesce("legal_name_y", "bn_y"), "disambiguated": F.col("_sure_x") & F.col("_sure_y"),
        "transfer_xy": F.coalesce("_xy", F.lit(0)), "transfer_yx": F.coalesce("_yx", F.lit(0)),
        "joint_grants_count": F.when(both, F.col("_n_x") + F.col("_n_y")).otherwise(0), "joint_grants_value": F.when(both, F.col("_v_x") + F.col("_v_y")).otherwise(0),
        "shared_contract_value": F.coalesce("_c_x", F.lit(0)) + F.coalesce("_c_y", F.lit(0)),
    })
    return pairs.withColumn("rank_score", F.col("transfer_xy") + F.col("transfer_yx") + F.col("joint_grants_value") * F.lit(0.5))


@view("related_parties_stats", "total_multi_board:l max_boards:l total_disambiguated:l pairs_with_financial_edge:l", "directors financial charities transfers grants contracts", f"""
  SELECT count(*) AS total_multi_board, max(board_count) AS max_boards, count(*) FILTER (disambiguated) AS total_disambiguated, (SELECT count(*) FROM ({_FLOWS}) WHERE transfer_xy + transfer_yx > 0 OR joint_grants_value > 0) AS pairs_with_financial_edge FROM ({_MULTI})""")  # fmt: skip
def related_parties_stats(t):
    """Pairs with money are counted and not made: of a person's g boards with grants, g * (g - 1) / 2, and of the others
    those with a transfer between them."""
    people = director_multi_board(t).agg(F.count("*").alias("total_multi_board"), F.coalesce(F.max("board_count"), F.lit(0)).alias("max_boards"), F.count_if("disambiguated").alias("total_disambiguated"))
    granted = t["grants"].where((F.col("agreement_value") > 0) & (F.length("recipient_business_number") >= 9)).select(bn_prefix(F.col("recipient_business_number")).alias("bn_prefix")).distinct()
    by_person = director_board_links(t).join(granted, "bn_prefix", "left_semi").groupBy("person_key").agg(F.count("*").alias("g"))
    both = by_person.agg(F.coalesce(F.sum(F.col("g") * (F.col("g") - 1) / 2), F.lit(0)).cast("long").alias("both"))
    moved = transfers_within(t)
    for side in "xy":
        moved = moved.join(granted.select(F.col("bn_prefix").alias(f"bn_{side}"), F.lit(True).alias(f"_g{side}")), f"bn_{side}", "left")
    others = moved.where("_gx IS NULL OR _gy IS NULL").agg(F.count("*").alias("others"))
    return people.crossJoin(both).crossJoin(others).withColumn("pairs_with_financial_edge", F.col("both") + F.col("others"))  # a row each


def transfers_within(t) -> DataFrame:
    """(person_key, bn_x, bn_y): pairs of one person's boards with a transfer between them, bn_x < bn_y, each once.

    From the transfers: an edge meets the people of its one end, and of these those who are on the other; a person's
    boards are never paired with each other.
    """
    links = director_board_links(t).select("person_key", "bn_prefix")
    a, b = bn_prefix(F.col("donor_bn")), bn_prefix(F.col("donee_bn"))
    edges = t["transfers"].where("total_gifts > 0").select(F.least(a, b).alias("bn_x"), F.greatest(a, b).alias("bn_y")).where("bn_x < bn_y").distinct()
    one = edges.join(links.withColumnRenamed("bn_prefix", "bn_x"), "bn_x")
    return one.join(links.withColumnRenamed("bn_prefix", "bn_y"), ["person_key", "bn_y"], "left_semi").select("person_key", "bn_x", "bn_y")


@view("related_parties", "first_name:s last_name:s org_count:l bns:a charities:a disambiguated:b", "directors financial charities", f"SELECT split_part(person_key, '|', 1) AS first_name, split_part(person_key, '|', 2) AS last_name, board_count AS org_count, bn_prefixes AS bns, charities, disambiguated FROM ({_MULTI})")
def related_parties(t):
    part = lambda i: F.split_part("person_key", F.lit("|"), F.lit(i))
    return director_multi_board(t).select(part(1).alias("first_name"), part(2).alias("last_name"), F.col("board_count").alias("org_count"), F.col("bn_prefixes").alias("bns"), "charities", "disambiguated")


@view("multi_board_without_flow", "person_key:s board_count:l", "directors financial charities transfers grants contracts", f"SELECT person_key, board_count FROM ({_MULTI}) WHERE person_key NOT IN (SELECT person_key FROM ({_FLOWS}) WHERE transfer_xy + transfer_yx > 0)")
def multi_board_without_flow(t):
    return director_multi_board(t).join(transfers_within(t), "person_key", "left_anti")


@view("flow_pairs", "bn_x:s bn_y:s person_key:s rank_score:d", "directors financial charities transfers grants contracts", f"SELECT bn_x, bn_y, person_key, rank_score FROM ({_FLOWS}) WHERE rank_score > 0 QUALIFY row_number() OVER (PARTITION BY bn_x, bn_y ORDER BY rank_score DESC, person_key) = 1")
def flow_pairs(t):
    """Each pair of charities once, by the person who comes first."""
    f = governance_flow_links(t).where("rank_score > 0")
    return rel.first_by(f, ["bn_x", "bn_y"], ["person_key", "rank_score"], F.struct(-F.col("rank_score"), "person_key"))
