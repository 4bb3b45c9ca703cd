"""Relational building blocks that several views share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by `order` (which has to break ties); Spark prunes before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_by(df: DataFrame, keys: list[str], columns: list[str], order: Column) -> DataFrame:
    """Like latest_per_key for few columns, as an aggregate with partial sums: the struct with the least `order`."""
    best = F.min_by(F.struct(*columns), order)
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in columns])


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def rolling_forward(df: DataFrame, keys: list[str], date: str, value: str, months: int) -> DataFrame:
    """For each (keys, date): how many rows fall in [date, date + months] and their sum, counted once for every
    row that starts there, as the range self-join has it; a RANGE frame, so nothing is joined."""
    over = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY {date} RANGE BETWEEN CURRENT ROW AND INTERVAL {months} MONTH FOLLOWING)"
    w = df.select(*keys, date, F.expr(f"count(*) {over}").alias("_n"), F.expr(f"sum({value}) {over}").alias("_s"))
    return w.groupBy(*keys, date).agg(F.sum("_n").alias("rows_in_window"), F.sum("_s").alias("sum_in_window"))


def concentration(totals: DataFrame, segment: str, name: str, value: str, count: str, top: int = 20) -> DataFrame:
    """Per segment the `top` names by value with their shares, and a summary row with HHI, CR4 and CR10 over all names.

    `totals` has one row for each (segment, name), so the window sorts names and not contracts.
    """
    by = Window.partitionBy(segment)
    ranked = totals.withColumn("rnk", F.row_number().over(by.orderBy(F.desc(value), name)))
    ranked = ranked.withColumns({"seg_total_value": F.sum(value).over(by), "seg_contract_count": F.sum(count).over(by), "seg_vendor_count": F.count("*").over(by)})
    ranked = ranked.withColumn("share_pct", F.col(value).cast("double") / F.nullif(F.col("seg_total_value").cast("double"), F.lit(0.0)) * 100.0)
    summary = ranked.groupBy(segment).agg(
        F.max("seg_total_value").alias("seg_total_value"), F.max("seg_contract_count").alias("seg_contract_count"), F.max("seg_vendor_count").alias("seg_vendor_count"),
        F.sum(F.col("share_pct") * F.col("share_pct")).alias("hhi"),
        F.sum(F.when(F.col("rnk") <= 4, F.col("share_pct")).otherwise(0.0)).alias("cr4"),
        F.sum(F.when(F.col("rnk") <= 10, F.col("share_pct")).otherwise(0.0)).alias("cr10"),
    )
    rows = summary.select(segment, F.lit("*SEGMENT*").alias(name), F.col("seg_total_value").alias(value), F.col("seg_contract_count").alias(count), F.lit(0).alias("rnk"), "seg_total_value", "seg_contract_count", "seg_vendor_count", "hhi", "cr4", "cr10")
    return rows.unionByName(ranked.where(F.col("rnk") <= top), allowMissingColumns=True)


def hhi(shares: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Herfindahl-Hirschman index (0 to 10000) of `value` within keys, from one row for each competitor."""
    share = F.col(value).cast("double") / F.nullif(F.sum(value).over(Window.partitionBy(*keys)).cast("double"), F.lit(0.0)) * 100.0
    return shares.withColumn("_s", share).groupBy(*keys).agg(F.sum(F.col("_s") * F.col("_s")).alias("hhi"))


def sort_by(df: DataFrame, allowed: dict[str, str], key: str | None, descending: bool, default: str) -> DataFrame:
    """Order by a whitelisted key, nulls last either way; an unknown key means the default."""
    c = F.col(allowed.get(key or "", allowed[default]))
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last())


def page(df: DataFrame, limit: int, offset: int = 0, most: int = 100) -> DataFrame:
    return df.offset(max(0, offset)).limit(max(1, min(limit, most)))


def anti_insert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `incoming` whose keys (null-safe) `existing` lacks, one for each key."""
    e = existing.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return incoming.dropDuplicates(keys).join(e, same, "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """`existing` with rows of `incoming` put in, which win on equal keys; to be written to a new place."""
    n = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    rest = [c for c in existing.columns if c not in keys]
    return latest_per_key(n, keys, [F.desc("_new"), *[F.col(c) for c in rest]]).drop("_new")


def upsert_greatest(existing: DataFrame, incoming: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value) of both, the greatest value of each key; chunks may come in any order, and repeatedly."""
    return existing.select(*keys, value).unionByName(incoming.select(*keys, value)).groupBy(*keys).agg(F.max(value).alias(value))


def update_where_distinct(target: DataFrame, staged: DataFrame, key: str, value: str) -> DataFrame:
    """`target` with `value` taken from `staged` (one row a key) where it differs, nulls too; _changed tells which rows."""
    new = staged.select(key, F.col(value).alias("_v"), F.lit(True).alias("_found"))
    out = target.join(new, key, "left").withColumn("_changed", F.col("_found").isNotNull() & ~F.col(value).eqNullSafe(F.col("_v")))
    return out.withColumn(value, F.when(F.col("_changed"), F.col("_v")).otherwise(F.col(value))).select(*target.columns, "_changed")


def update_paired(target: DataFrame, staged: DataFrame, keys: list[str], id_: str, order: list[Column], values: list[str]) -> DataFrame:
    """`target` with `values` of the staged row of equal keys (null-safe) and equal place: rows that share their keys
    are paired in order, the target's by `id_` and the staged ones by `order`; the rest keeps what it has."""
    t = target.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(id_)))
    s = staged.withColumn("_sn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    s = s.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_sn", *[F.col(v).alias(f"_v_{v}") for v in values])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_rn") == F.col("_sn")]
    taken = {v: F.when(F.col("_sn").isNotNull(), F.col(f"_v_{v}")).otherwise(F.col(v)) for v in values}
    return t.join(s, same, "left").withColumns(taken).select(*target.columns)


def fill_by_mode(df: DataFrame, source: str, target: str, enough: float = 0.95) -> DataFrame:
    """Fill null `target` with the commonest one of its `source` value (ties: the least), unless `enough` are filled."""
    counts = df.where(F.col(target).isNotNull() & F.col(source).isNotNull()).groupBy(F.col(source).alias("_s"), F.col(target).alias("_t")).count()
    mode = counts.groupBy("_s").agg(F.min_by("_t", F.struct(-F.col("count"), "_t")).alias("_mode"))
    filled = df.agg((F.count(target) / F.greatest(F.count("*"), F.lit(1)) >= enough).alias("_enough"))  # a row
    out = df.join(mode, F.col(source) == F.col("_s"), "left").crossJoin(F.broadcast(filled))
    out = out.withColumn(target, F.when(F.col("_enough"), F.col(target)).otherwise(F.coalesce(target, "_mode")))
    return out.select(*df.columns)
