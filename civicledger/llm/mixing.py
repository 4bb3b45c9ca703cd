"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash of its id. Words are summed by (source, top hash bits); a cumulative
sum per source finds the bucket in which the source's budget ends; only the documents of that bucket are
summed again by their next bits, and so on until one hash value is left. What remains is one threshold per
source, and the mix is a filter `hash < threshold`: no document is sorted, and thresholds of smaller budgets
are nested in those of larger ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop, table, word_count

BITS, LEVELS = 12, 5  # 60 bits of hash in all
TOP = 1 << (BITS * LEVELS)


def id_hash(key: Column) -> Column:
    """The first 60 bits of the MD5 of the id's decimal text, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> also target: `share` of all words dealt by weight, none above `most` times its source.

    Weights repeat over the sources by code point, null last. Resharing the excess until no target is above its
    cap ends in target = min(cap, level * weight); the level is found by adding sources in the order in which
    they reach their caps. One row per source: this table is the mixture's own specification.
    """
    by_name, by_cap = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("_r", "_n")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_n") - 1) % len(weights) + 1)
    d = totals.withColumn("_n", F.row_number().over(by_name)).withColumn("_w", w)
    d = d.withColumn("_cap", F.lit(float(most)) * F.col("source_size")).withColumn("_r", F.col("_cap") / F.col("_w"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_used", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    d = d.withColumn("_left", F.sum("_w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
    every = Window.partitionBy(F.lit(1))
    d = d.withColumn("_level", (F.lit(float(share)) * F.sum("source_size").over(every) - F.col("_used")) / F.col("_left"))
    d = d.withColumn("_free", F.when(F.col("_level") <= F.col("_r"), F.col("_level")))
    level = F.min(F.when(F.col("_free").isNotNull(), F.struct("_r", "_n", "_free"))).over(every)["_free"]
    d = d.withColumn("target", F.when(level.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), level * F.col("_w"))))
    return d.select("source", "source_size", "target")


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, size, h) and (source, source_size, target) -> also epochs and threshold, one row per source.

    A source's documents are taken `epochs` times whole, and once more where h < threshold; the words of that
    last part miss the budget by at most half the document at the boundary.
    """
    state = targets.withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    )
    state = state.withColumn("_budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    state = cut(state.withColumn("_prefix", F.lit(0).cast("long")).withColumn("threshold", F.lit(None).cast("long")), "mix-state")
    rest, done = sized, []
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        last, before = level == LEVELS - 1, state
        open_ = state.where(F.col("threshold").isNull()).select(F.col("source").alias("_s"), "_prefix", "_budget")
        if level:
            near = (F.col("source").eqNullSafe(F.col("_s"))) & (F.shiftright("h", shift + BITS) == F.col("_prefix"))
            rest = rest.join(open_, near, "left_semi")
            if level == 1:
                rest = cut(rest, "mix-boundary")
                done.append(rest)
        hist = rest.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        hist = hist.join(open_, F.col("source").eqNullSafe(F.col("_s")))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        hist = hist.withColumn("upto", upto).where(F.col("upto") > F.col("_budget"))
        edge = F.min(F.struct("bucket", "upto", "words"))
        edge = hist.groupBy(F.col("source").alias("_s")).agg(edge.alias("e"))
        state = state.join(edge, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        left = F.col("_budget") - (F.col("e.upto") - F.col("e.words"))
        # no bucket passes the budget: all that is left below the prefix's end is taken
        end = F.shiftleft(F.col("_prefix") + 1, shift + BITS)
        found = F.col("e.bucket") + F.when(F.col("e.upto") - F.col("_budget") < left, 1).otherwise(0) if last else F.lit(None).cast("long")
        state = state.withColumn(
            "threshold", F.when(F.col("threshold").isNotNull(), F.col("threshold")).when(F.col("e").isNull(), end).otherwise(found)
        )
        state = state.withColumn("_prefix", F.coalesce("e.bucket", "_prefix")).withColumn("_budget", F.coalesce(left, "_budget")).drop("e")
        done.append(before)
        state = cut(state, "mix-state")
    drop(*done)
    return state.drop("_prefix", "_budget")


def mix(docs: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per document: doc_id, source, size (words), source_size, target, copies, taken = size * copies.

    Null or empty texts have size 0 and take part with it; a null source is a source of its own, the last one.
    Rows of a source with equal doc_id (repeated rows, null ids) have one hash and share one fate, so a source of
    few different ids can't come near its target: thresholds part ids, not rows. An empty table gives an empty
    result. Other columns of `docs` are ignored, so their names cannot clash.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), id_hash(F.col("doc_id")).alias("h"))
    sized = cut(sized, "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    state = thresholds(sized.select("source", "size", "h"), source_targets(totals, weights, share, most))
    state = state.withColumnRenamed("source", "_s")
    out = sized.join(state, F.col("source").eqNullSafe(F.col("_s")))
    copies = F.col("epochs") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: rows of `docs`, all their columns, each as often as the mix takes it (0 to 2 times)."""
    chosen = mix(docs, **how).where("copies > 0").groupBy("source", "doc_id").agg(F.max("copies").alias("_copies"))
    chosen = chosen.withColumnsRenamed({"doc_id": "_mix_id", "source": "_mix_source"})
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))  # so that no name can clash
    rows = row.join(chosen, F.col("_row.doc_id").eqNullSafe(F.col("_mix_id")) & F.col("_row.source").eqNullSafe(F.col("_mix_source")))
    rows = rows.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return rows.select(*[F.col(f"_row.`{c}`") for c in docs.columns])


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op9_mix_sources": op9_mix_sources}

ORACLE = {
    "op9_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s1 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
s2 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS n FROM s1),
s3 AS (SELECT *, CAST(CASE (n - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w, CAST(2.0 AS DOUBLE) * source_size AS cap FROM s2),
s4 AS (SELECT *, cap / w AS r FROM s3),
s5 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY r, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
              sum(w) OVER (ORDER BY r, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
              CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s4),
s6 AS (SELECT *, (CAST(1.5 AS DOUBLE) * total - used) / rest AS lev FROM s5),
s7 AS (SELECT *, (SELECT lev FROM s6 WHERE lev <= r ORDER BY r, n LIMIT 1) AS level FROM s6),
s8 AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * w) END AS target FROM s7),
s9 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM s8),
d AS (SELECT z.*, t.source_size, t.target, t.epochs, t.target - t.epochs * t.source_size AS budget
      FROM sized z JOIN s9 t ON z.source IS NOT DISTINCT FROM t.source),
g AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
c AS (SELECT source, h, words, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
e AS (SELECT d.*, c.upto, c.words FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h),
b AS (SELECT source, min(h) AS edge FROM e WHERE upto > budget GROUP BY source),
x AS (SELECT DISTINCT e.source, e.h + CASE WHEN e.upto - e.budget < e.budget - (e.upto - e.words) THEN 1 ELSE 0 END AS threshold
      FROM e JOIN b ON e.source IS NOT DISTINCT FROM b.source AND e.h = b.edge)
SELECT e.doc_id, e.size, e.source_size, e.target,
       CAST(e.size * (e.epochs + CASE WHEN x.threshold IS NULL OR e.h < x.threshold THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM e LEFT JOIN x ON e.source IS NOT DISTINCT FROM x.source
"""
}
