"""Line dedup by winnowing over line hashes, in DataFrame functions throughout.

Lines are hashed; k-grams of line hashes are winnowed: of every w neighbouring grams the least one (leftmost of
equals) is a fingerprint, so any run of t = w + k - 1 equal lines has a fingerprint at the same place in all
its copies. Positions whose fingerprint occurs once are settled. The others are extended both ways to the
t-line windows around them, windows are matched by hash against the first place that has the same lines, and
every line in a window that isn't the first is deleted: unions of overlapping windows are the maximal later
runs. No pair of positions is ever formed, so a run in a third of all documents costs a row for each.

Runs of one or two lines with more than 50 words are windows of their own, matched in the same way. A line is in
three of them at most and each has over 50 words, so that they are few beside the words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, table, word_count

GRAM, WINDOW = 2, 2
WORDS = 50


def _passages(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, s, n, run): runs of n = 1 or 2 lines from line s on that have more than `words` words."""
    lines = docs.select("doc_id", F.split("text", "\n").alias("l")).where("l is not null")
    lines = lines.select("doc_id", F.transform("l", lambda x: F.struct(F.xxhash64(x).alias("h"), word_count(x).alias("c"))).alias("l"))
    at = lambda i: F.get("l", i)
    one = F.transform(F.sequence(F.lit(0), F.size("l") - 1), lambda i: F.struct(i.alias("s"), F.lit(1).alias("n"), at(i)["h"].alias("run"), at(i)["c"].alias("c")))
    two = F.transform(F.sequence(F.lit(0), F.size("l") - 1), lambda i: F.struct(i.alias("s"), F.lit(2).alias("n"), F.xxhash64(at(i)["h"], at(i + 1)["h"]).alias("run"), (at(i)["c"] + at(i + 1)["c"]).alias("c")))
    runs = F.filter(F.concat(one, two), lambda x: x["c"] > words)
    return lines.select("doc_id", F.explode(runs).alias("x")).select("doc_id", "x.s", "x.n", "x.run")


def _later_windows(docs: DataFrame, k: int, w: int, words: int | None) -> DataFrame:
    """(doc_id, runs): s and n where a document has, from line s on, n lines that another place has earlier.

    n is t = w + k - 1, or 1 and 2 for runs of more than `words` words.
    """
    t = w + k - 1
    h = docs.select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.xxhash64(x)).alias("h")).where(F.size("h") >= t)

    def at(i, n):
        return F.xxhash64(*[F.element_at("h", (i + 1 + j).cast("int")) for j in range(n)])

    grams = h.withColumn("g", F.transform(F.sequence(F.lit(0), F.size("h") - k), lambda i: at(i, k)))

    def least(j):
        some = F.slice("g", j + 1, w)
        return j + F.array_position(some, F.array_min(some)).cast("int") - 1

    picked = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("g") - w), least))
    around = lambda p: F.transform(
        F.filter(F.array(*[p - j for j in range(w)]), lambda s: (s >= 0) & (s <= F.size("h") - t)), lambda s: F.struct(s.alias("s"), at(s, t).alias("run"))
    )
    marks = F.transform(picked, lambda p: F.struct(F.element_at("g", (p + 1).cast("int")).alias("mark"), around(p).alias("windows")))
    marks = cut(grams.select("doc_id", F.explode(marks).alias("m")).select("doc_id", "m.mark", "m.windows"), "line-marks")
    common = marks.groupBy("mark").count().where("count > 1").select("mark")
    windows = marks.join(common, "mark", "left_semi").select("doc_id", F.explode("windows").alias("x")).select("doc_id", "x.s", "x.run")
    windows = windows.select("doc_id", "s", F.lit(t).alias("n"), "run")
    if words is not None:
        windows = windows.union(_passages(docs, words))
    windows = cut(windows.distinct(), "line-windows")
    place = F.struct("doc_id", "s")
    firsts = windows.groupBy("n", "run").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("n", "run", "first")
    later = windows.join(firsts, ["n", "run"]).where(place > F.col("first"))
    out = cut(later.groupBy("doc_id").agg(F.collect_set(F.struct("s", "n")).alias("runs")), "line-later")
    drop(marks, windows)
    return out


def dedup_lines(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, words: int | None = WORDS) -> DataFrame:
    """`docs` (all columns, text without its deleted lines) and n_lines, n_removed.

    A line goes if it lies in `window + gram - 1` consecutive lines, or in one or two lines of more than `words`
    words together (None: no such rule), that equal lines starting at an earlier place: a smaller doc_id, or the
    same document further up. The first copy of every run stays. Lines are what newlines separate, compared byte
    for byte by 64-bit hash. Texts with neither kind of run keep all lines; a null text
    stays null with 0 lines, an empty one has one line. Rows that repeat a doc_id are one document, and stay
    alike; null ids come first. Nothing is done to an empty table. The lines of a text are arrays of its row: a text
    of very many lines takes about a hundred bytes a line in one task.
    """
    later = _later_windows(docs.select("doc_id", "text"), gram, window, words).withColumnRenamed("doc_id", "_later_id")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))  # so that no name can clash
    rows = row.join(later.hint("merge"), F.col("_row.doc_id").eqNullSafe(F.col("_later_id")), "left")
    rows = rows.withColumn("_lines", F.split("_row.text", "\n"))
    gone = F.flatten(F.transform("runs", lambda x: F.sequence(x["s"], x["s"] + x["n"] - 1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), gone)
    changed = F.col("runs").isNotNull()
    text = F.when(changed, F.array_join(F.transform(kept, lambda i: F.element_at("_lines", i + 1)), "\n")).otherwise(F.col("_row.text"))
    n = F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")).cast("long")
    removed = F.when(changed, F.size("_lines") - F.size(kept)).otherwise(0).cast("long")
    own = [F.col(f"_row.`{c}`") for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    return rows.select(*own, text.alias("text"), n.alias("n_lines"), removed.alias("n_removed"))


def _digests(out: DataFrame) -> DataFrame:
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return out.select("doc_id", "n_lines", "n_removed", digest.alias("kept_sha256"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three lines alone, as its SQL has it; op4_passage_dedup has short runs of many words as well."""
    return _digests(dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), words=None))


def op4_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three lines, and runs of one or two lines with more than 50 words: what the pipeline does."""
    return _digests(dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {"op4_line_dedup": op4_line_dedup, "op4_passage_dedup": op4_passage_dedup}

ORACLE = {
    "op4_line_dedup": r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, s, l[s + 1] || chr(10) || l[s + 2] || chr(10) || l[s + 3] AS run
      FROM (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS s FROM d WHERE len(l) >= 3)),
f AS (SELECT run, min({'d': doc_id, 's': s}) AS f FROM w GROUP BY run),
g AS (SELECT DISTINCT w.doc_id, w.s + k AS i
      FROM w JOIN f ON w.run = f.run, (SELECT unnest(range(0, 3)) AS k) WHERE {'d': w.doc_id, 's': w.s} > f.f),
r AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(CASE WHEN gone IS NULL THEN text ELSE
         array_to_string(list_transform(list_filter(range(0, len(l)), lambda i: NOT list_contains(gone, i)), lambda i: l[i + 1]), chr(10)) END, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
""",
    "op4_passage_dedup": r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
p AS (SELECT doc_id, l, unnest(range(0, len(l))) AS s FROM d),
c AS (SELECT doc_id, s, n, array_to_string(l[s + 1:s + n], chr(10)) AS run FROM p, (SELECT unnest([1, 2, 3]) AS n) WHERE s + n <= len(l)),
w AS (SELECT doc_id, s, n, run FROM c WHERE n = 3 OR len(regexp_extract_all(run, '[^\x20\x09-\x0D]+')) > 50),
f AS (SELECT n, run, min({'d': doc_id, 's': s}) AS f FROM w GROUP BY n, run),
x AS (SELECT w.doc_id, unnest(range(w.s, w.s + w.n)) AS i FROM w JOIN f ON w.n = f.n AND w.run = f.run WHERE {'d': w.doc_id, 's': w.s} > f.f),
r AS (SELECT doc_id, list(DISTINCT i) AS gone FROM x GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(CASE WHEN gone IS NULL THEN text ELSE
         array_to_string(list_transform(list_filter(range(0, len(l)), lambda i: NOT list_contains(gone, i)), lambda i: l[i + 1]), chr(10)) END, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
""",
}
