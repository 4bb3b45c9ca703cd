"""Full-text search: an inverted index of terms with counts, places and document lengths, and ranked requests over it.

A request is a list of conditions that must all hold; each has one or more alternatives, and an alternative of several
words is a phrase. Only the postings of the request's own terms are read: from a stored index by bucket and by term,
and from an index that isn't stored by a filter that Catalyst pushes below the grouping. Ranks are BM25.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A term is a run of letters and digits, in lower case.
TERM = r"[\p{L}\p{N}]+"
BUCKETS = 256
#: Files that a bucket's postings are spread over at most, by document: a frequent term isn't one task's work.
SPREAD = 8
K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


def request(q: str) -> list[list[tuple[str, ...]]]:
    """Conditions of `q`: words and "phrases" must all be there; OR between two of them lets either do."""
    import regex

    out, either = [], False
    for phrase, word in re.findall(r'"([^"]*)"|(\S+)', q):
        if word == "OR":
            either = bool(out)
            continue
        words = tuple(regex.findall(TERM, (phrase or word).lower()))
        if not words:
            continue
        if either:
            out[-1].append(words)
        else:
            out.append([words])
        either = False
    return out


@dataclass
class Index:
    """postings: (term, key, n, places, length); size: one row of docs and total length."""

    postings: DataFrame
    size: DataFrame
    stored: bool = False

    def of(self, words: list[str]) -> DataFrame:
        found = self.postings.where(F.col("term").isin(words))
        if self.stored:  # other buckets' folders aren't opened
            found = found.where(F.col("bucket").isin(sorted({r[0] for r in bucket_numbers(self.postings.sparkSession, words)})))
        return found.select("term", "key", "n", "places", "length")


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def bucket_numbers(spark: SparkSession, words: list[str]):
    """The request's own words' buckets, as Spark hashes them (a local relation: no job)."""
    return spark.createDataFrame([(w,) for w in words], "term string").select(bucket_of(F.col("term"))).collect()


def index(rows: DataFrame, key: str, *texts: str) -> Index:
    """The index of `texts` of rows with a unique `key`; a row without terms counts as a document of length 0."""
    own = rows.select(F.col(key).alias("key"), terms(F.concat_ws(" ", *texts)).alias("words"))
    listed = own.select("key", F.size("words").alias("length"), F.posexplode("words").alias("place", "term"))
    postings = listed.groupBy("term", "key", "length").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("place")).alias("places"))
    return Index(postings, own.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("total")))


def store(index: Index, path: str) -> Index:
    """Write an index: postings by bucket of their term, sorted by term within a file, so that a request reads few row groups."""
    rows = index.postings.withColumn("bucket", bucket_of(F.col("term")))
    rows = rows.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(SPREAD))).sortWithinPartitions("bucket", "term", "key")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    index.size.write.mode("overwrite").parquet(f"{path}/size")
    return load(rows.sparkSession, path)


def load(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/size"), True)


def holds(alternative: tuple[str, ...], places) -> Column:
    """Whether the words stand one after the other, given their places by word."""
    first, *rest = alternative
    if not rest:
        return places(first).isNotNull()

    def after(at: Column) -> Column:
        out = F.array_contains(places(rest[0]), at + 1)
        for i, word in enumerate(rest[1:], 2):
            out = out & F.array_contains(places(word), at + i)
        return out

    return F.coalesce(F.exists(places(first), after), F.lit(False))


def search(index: Index, wanted: list[list[tuple[str, ...]]]) -> DataFrame:
    """(key, score) of all documents that meet every condition; order by score and key for a page of them.

    A request without a term finds nothing. Every term of the request counts in the score, also those of alternatives.
    """
    words = sorted({w for condition in wanted for alternative in condition for w in alternative})
    found = index.of(words)
    held = F.broadcast(found.groupBy("term").agg(F.count("*").alias("df")))  # a row for each word of the request
    docs, total = index.size.select("docs").scalar(), index.size.select("total").scalar()
    idf = F.log(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("n") * (K1 + 1) / (F.col("n") + K1 * (1 - B + B * F.col("length") * docs / total))
    column = {w: f"p{i}" for i, w in enumerate(words)}
    places = [F.max(F.when(F.col("term") == w, F.col("places"))).alias(column[w]) for w in words]
    by_key = found.join(held, "term").groupBy("key").agg(F.sum(idf * weight).alias("score"), *places)
    meets = F.lit(bool(words))
    for condition in wanted:
        any_of = F.lit(False)
        for alternative in condition:
            any_of = any_of | holds(alternative, lambda w: F.col(column[w]))
        meets = meets & any_of
    return by_key.where(meets).select("key", "score")


def page(found: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    """The best `limit` after the first `offset`; equal scores by key."""
    return found.orderBy(F.round("score", 9).desc(), "key").offset(offset).limit(limit)
