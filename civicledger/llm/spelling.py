"""Spelling variants: words one edit apart, grouped under the form that is written much more often.

Symmetric deletion: every word emits itself and its distinct single deletions, and two words at distance one meet
under exactly one of these keys: an insertion's shorter word, or what both leave without the replaced letter
(another pair of deletions that give equal strings lies in a run of equal letters and gives the same key). So
the equi-join needs no second deduplication; an exact check takes away what shares a key at distance two. The
words of a key are those with one letter more at one of its places: their number is bounded by the key's length
times the alphabet of 90 letters, whatever the corpus.

Spark sizes the keys as the words' compressed file, without the explode, and would send them all through the driver
to be broadcast; joins of what grows with the words are therefore marked as merges.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, drop, table, text_batches

#: A run of letters, after ASCII letters are lower-cased.
RUN = re.compile("[a-zÀ-ÿ]+")
#: Distinct words that a task sums up before it sends them on.
HELD = 200_000
#: Letters of a broadcast table of words at most, as no word's length is bounded.
BROADCAST_LETTERS = 8 << 20


def count_words(docs: DataFrame, every: int = 97) -> DataFrame:
    """(word, n): words of all whole texts as written, with the planted deletions: n occurrences each.

    Where crc32 of `<doc_id>:<word>` is a multiple of `every`, that document's occurrences of the word lack the
    letter at crc32 modulo its length. Null texts have no words; a null id is written as nothing.
    """

    def count(batches):
        import zlib
        from collections import Counter

        import pyarrow as pa

        total: Counter = Counter()

        def sent():
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in text_batches(batches):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                prefix = zlib.crc32(f"{'' if key is None else key}:".encode())
                for word, n in Counter(RUN.findall(text.encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), prefix)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    total[word] += n
                if len(total) > HELD:
                    yield sent()
        if total:
            yield sent()

    rows = docs.select(F.col("doc_id").cast("string").alias("key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n) of distinct words (word, n): all pairs at distance one, each from both of its ends."""
    lacking = F.transform(
        F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substr("word", F.lit(1), i - 1), F.substr("word", i + 1, F.length("word")))
    )
    keys = words.select(F.explode(F.array_distinct(F.concat(F.array("word"), lacking))).alias("key"), "word", "n")
    left, right = keys.select("key", F.col("word").alias("a"), F.col("n").alias("a_n")), keys.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    pairs = left.join(right.hint("merge"), "key").where((F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 1) == 1))
    ends = [F.struct(F.col(x).alias("word"), F.col(f"{x}_n").alias("n"), F.col(y).alias("near"), F.col(f"{y}_n").alias("near_n")) for x, y in ("ab", "ba")]
    return pairs.select(F.inline(F.array(*ends)))


def sent(roots: DataFrame) -> DataFrame:
    """A written table (word, root) for the right side of a join: broadcast if its rows and letters are few, else merged."""
    rows, letters = roots.agg(F.count("*"), F.coalesce(F.sum(F.length("word") + F.length("root")), F.lit(0))).first()
    return F.broadcast(roots) if rows <= BROADCAST_ROWS and letters <= BROADCAST_LETTERS else roots.hint("merge")


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form), one row per word: the last form of each chain, by jumps that double in length.

    Counts at least double from form to form, so chains are shorter than the counts' logarithm and have no loop.
    """
    state = cut(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = sent(state).select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(state.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        drop(state)
        state = moved.select("word", "root")
        state._table = moved._table
        if moved.where("moved").isEmpty():
            return state


def variants(docs: DataFrame, least: int = 3, letters: int = 5, ratio: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n, root: one row per word of `letters` or more with `least` or more occurrences.

    form is the near word of the largest n (ties: the smallest by code points) if that is `ratio` times the
    word's own n or more, else null; root follows forms to the last and is the word itself without one. Repeated
    rows count again; an empty table, or one of null and empty texts, gives an empty result. Only doc_id and text
    are read. A very long text is one Python string in its task; nothing else depends on a text's length, and
    `letters` bounds no word from above: a run of m letters makes m + 1 keys of m letters each.
    """
    return grouped(count_words(docs), least, letters, ratio)


def grouped(counts: DataFrame, least: int, letters: int, ratio: int) -> DataFrame:
    """The variants of counted words (word, n)."""
    words = cut(counts.where((F.col("n") >= least) & (F.length("word") >= letters)), "spelling-words")
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    own = words.join(near, "word", "left")
    found = F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.near"))
    out = cut(
        own.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), found.alias("form"), F.when(found.isNotNull(), -F.col("best.less")).alias("form_n")), "spelling-forms"
    )
    roots = follow(out.where("form is not null"))
    drop(words)
    return out.join(sent(roots), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {"op13_spelling": op13_spelling}
ORACLE: dict[str, str] = {}
