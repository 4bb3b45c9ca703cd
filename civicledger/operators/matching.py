"""Entity matching by number, by name and by vector, each taking only what the former left; nearest vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import same_letters
from ..sources.sinks import stored
from . import vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two vectors, null where one has no length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def cosine_top_k(vectors: DataFrame, query: list[float], k: int = 10, most: int = 50, source: str | None = None) -> DataFrame:
    """The k rows (vec_id, embedding) nearest one stated vector, which is a literal of the plan: a scan and a top-k.
    With `source` only the rows of that source."""
    vectors = vectors if source is None else vectors.where(F.col("source") == source)
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.withColumn("similarity", F.round(cosine(F.col("embedding"), q), 4))
    return scored.drop("embedding").orderBy(F.desc_nulls_last("similarity"), "vec_id").limit(min(k, most))


def match_entities(notices: DataFrame, entities: DataFrame, shortest: int = 4) -> DataFrame:
    """(notice_id, source, entity_name, bn, method, confidence): by number first, then by name.

    notices: notice_id, name_norm, bn_guess; entities: source, entity_name, name_norm, bn. A name match that the
    number already made is left out. Names are compared by a collation that knows no case and no
    accents, so that letters which normalising left as they are (beyond its list) meet their plain forms.
    """
    by_bn = notices.join(entities.where("bn is not null"), notices["bn_guess"] == entities["bn"]).select("notice_id", "source", "entity_name", "bn").distinct()
    by_bn = by_bn.withColumns({"method": F.lit("exact_bn"), "confidence": F.lit(1.0)})
    letters = lambda df: df.withColumn("letters", same_letters(F.col("name_norm"))).drop("name_norm")
    asked = notices.where(F.length("name_norm") >= shortest).select("notice_id", "name_norm")
    named = letters(asked).join(letters(entities), "letters").select("notice_id", "source", "entity_name", "bn").distinct()
    named = named.join(by_bn.select("notice_id", "source", "entity_name"), ["notice_id", "source", "entity_name"], "left_anti")
    return by_bn.unionByName(named.withColumns({"method": F.lit("exact_name"), "confidence": F.lit(0.95)}))


def matched_names(notices: DataFrame, entities: DataFrame, shortest: int = 4) -> DataFrame:
    """(entity_name), each once: those of match_entities(), without the pairs of notices and entities, which for a name
    that many have on both sides are the product of their numbers."""
    numbers = notices.where("bn_guess IS NOT NULL").select("bn_guess").distinct()
    letters = notices.where(F.length("name_norm") >= shortest).select(same_letters(F.col("name_norm")).alias("letters")).distinct()
    by_bn = entities.join(numbers, F.col("bn") == F.col("bn_guess"), "left_semi").select("entity_name")
    named = entities.withColumn("letters", same_letters(F.col("name_norm"))).join(letters, "letters", "left_semi").select("entity_name")
    return by_bn.unionByName(named).distinct()


#: Components of a name's vector.
NAME_DIMENSIONS = 256


def name_vectors(names: DataFrame) -> DataFrame:
    """(id, embedding) of distinct names (id): counts of letter triples, dealt to NAME_DIMENSIONS by their characters.

    It stands for a trained embedding, which would take its place as a column of the same kind.
    """

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, vectors.CHUNK):
                part = batch.column(0).slice(start, vectors.CHUNK)
                out = np.zeros((len(part), NAME_DIMENSIONS))
                for i, text in enumerate(part.to_pylist()):
                    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
                    if len(code) > 2:
                        out[i] = np.bincount((code[:-2] * 961 + code[1:-1] * 31 + code[2:]) % NAME_DIMENSIONS, minlength=NAME_DIMENSIONS)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * NAME_DIMENSIONS), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([part, lists], ["id", "embedding"])

    return names.where("id is not null").mapInArrow(count, "id string, embedding array<double>")


#: Rows and letters of a table of names that is broadcast, at most.
SENT_ROWS, SENT_LETTERS = 100_000, 4 << 20


def match_by_vector(left_over: DataFrame, entities: DataFrame, least: float = 0.72, shortest: int = 4, exact: bool = True) -> DataFrame:
    """(notice_id, source, entity_name, bn, method, confidence): for notices that number and name left, the most
    similar entity of all, if its similarity is `least` or more; ties go to the smallest normalised name.

    Each different name is stored and searched once, in an inverted file of the entities' vectors; without `exact`
    only the lists nearest to a name are looked into.
    """
    left_over = stored(left_over.select("notice_id", "name_norm"), "left-over")
    asked = left_over.where(F.length("name_norm") >= shortest).select(F.col("name_norm").alias("id")).distinct()
    known = stored(entities.where(F.length("name_norm") >= shortest).groupBy("name_norm").agg(F.min(F.struct("source", "entity_name", "bn")).alias("e")), "known")
    lists = vectors.build(name_vectors(known.select(F.col("name_norm").alias("id"))))
    near = stored(lists.nearest(name_vectors(asked), least=least, exact=exact).withColumnRenamed("id", "asked"), "near")
    # the stored tables compress well: left to itself, Spark would broadcast notices and entities by the size of their files
    rows, letters = near.agg(F.count("*"), F.coalesce(F.sum(F.length("asked") + F.length("near")), F.lit(0))).first()
    marked = lambda df: F.broadcast(df) if rows <= SENT_ROWS and letters <= SENT_LETTERS else df.hint("merge")
    hit = marked(near).join(known.withColumnRenamed("name_norm", "near"), "near").select(F.col("asked").alias("name_norm"), "e.*", F.col("similarity").alias("confidence"))
    return left_over.join(marked(hit), "name_norm").select("notice_id", "source", "entity_name", "bn", F.lit("vector_cosine").alias("method"), "confidence")


#: Vectors of a packed chunk of the searched side, and of the asking one: a pair of chunks is one row of the join.
CHUNK, ASKED = 4096, 1024


def nearest_by_blocks(left: DataFrame, right: DataFrame, least: float = 0.72, apart: bool = False, chunk: int = CHUNK) -> DataFrame:
    """For each left row (left_id, embedding, block) the most similar right row (right_id, embedding, block) of its block.

    All rows of a block are compared, as matrix products of packed chunks; no row is made for a pair. A searched chunk
    stays where its block and number put it, and each asking chunk is sent to all of its block, so a large block is as
    many tasks as it has chunks. Ties (to 12 places) go to the smaller right_id. With `apart` a row isn't its own
    neighbour. Ids are bigint; vectors that are null, without length or not finite match nothing.
    """

    def packed(df, key, size):
        n = df.groupBy("block").agg(F.ceil(F.count("*") / size).cast("int").alias("_n"))
        rows = df.join(n, "block").withColumn("_part", F.pmod(F.xxhash64(key), "_n").cast("int"))
        return n, rows.groupBy("block", "_part").agg(F.collect_list(F.struct(F.col(key).cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("v"))).alias(f"_{key}"))

    def multiply(batches):
        import numpy as np
        import pyarrow as pa

        def unit(rows):
            rows = [(r["id"], r["v"]) for r in rows if r["v"] is not None and None not in r["v"]]
            rows = [(i, v) for i, v in ((i, np.array(v, float)) for i, v in rows) if 0 < np.linalg.norm(v) < np.inf]
            rows.sort(key=lambda r: r[0])
            return np.array([i for i, _ in rows], np.int64), np.array([v / np.linalg.norm(v) for _, v in rows])

        for batch in batches:
            for one in range(batch.num_rows):
                (a, x), (b, y) = (unit(batch.column(c)[one].as_py()) for c in (0, 1))
                if not len(a) or not len(b):
                    continue
                s = np.round(x @ y.T, 12)
                if apart:
                    s[a[:, None] == b] = -np.inf
                at = s.argmax(1)  # the first of equals, and ids ascend
                most = s[np.arange(len(a)), at]
                keep = most >= least
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[at[keep]]), pa.array(most[keep])], ["left_id", "right_id", "similarity"])

    _, asking = packed(left, "left_id", min(chunk, ASKED))
    n, searched = packed(right, "right_id", chunk)
    sent = asking.drop("_part").join(n, "block").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    found = sent.join(searched, ["block", "_part"]).select("_left_id", "_right_id").mapInArrow(multiply, "left_id bigint, right_id bigint, similarity double")
    best = found.groupBy("left_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("right_id").alias("r"))).alias("m"))
    return best.select("left_id", F.col("m.r").alias("right_id"), (-F.col("m.s")).alias("similarity"))
