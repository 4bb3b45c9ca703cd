"""Maximum-inner-product search by additive quantisation.

A vector is coded as a sum of one codeword from each of M full-dimensional codebooks. Codebooks are trained on
a bounded sample (residual k-means, then each codebook fitted to what the others leave of beam-searched codes); every vector
is coded by beam search, and stored with its code's scale and the length of what the scaled code leaves of it. Queries, in
blocks, score blocks of codes by table lookups. The best codes are checked by double precision inner products, and
then every other whose score could still reach the k-th best: by Cauchy and Schwarz a code's score is off by the lengths
of query and remainder at most, so nothing is missed, whatever the rows are like. Spark merges the best of every block and
expands them from distinct vectors to rows. Codes and vectors stay in the tasks' blocks: queries are broadcast to
them, a bounded number at a time.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop, table

BOOKS, WORDS, BEAM = 16, 256, 8
TRAIN = 16_384
CODE_BLOCK, QUERY_BLOCK = 32_768, 128
BLOCK_BYTES = 16 << 20  # vectors of a block, as doubles
PASS_BYTES = 8 << 20  # vectors of queries that are broadcast at a time
PAIRS = 1 << 19  # pairs whose products are summed in order at a time


def beam_encode(x, books, beam: int = BEAM):
    """Codes (n x M) of the rows of x, by beam search over all codebooks in turn."""
    import numpy as np

    n, d = x.shape
    out = np.zeros((n, len(books)), np.uint8)
    step = max(1, (1 << 22) // (beam * len(books[0])))
    for at in range(0, n, step):
        part = x[at : at + step]
        m = len(part)
        left, codes = part[:, None, :], np.zeros((m, 1, 0), np.uint8)
        for book in books:
            cost = (left**2).sum(2)[:, :, None] - 2 * left @ book.T + (book**2).sum(1)
            b, k = cost.shape[1], len(book)
            keep = min(beam, b * k)
            flat = cost.reshape(m, b * k)
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            rows, words = best // k, best % k
            left = np.take_along_axis(left, rows[:, :, None], 1) - book[words]
            codes = np.concatenate([np.take_along_axis(codes, rows[:, :, None], 1), words[:, :, None].astype(np.uint8)], 2)
        best = (left**2).sum(2).argmin(1)
        out[at : at + m] = codes[np.arange(m), best]
    return out


def train_books(x, books: int = BOOKS, words: int = WORDS, rounds: int = 1, seed: int = 11):
    """M codebooks (M x K x d) for the rows of a bounded sample x."""
    import numpy as np

    rng, left, out = np.random.default_rng(seed), x.astype(np.float32), []
    k = max(1, min(words, len(x)))
    for _ in range(books):
        c = left[rng.choice(len(left), k, replace=False)].copy()
        for _ in range(8):
            near = ((c**2).sum(1) - 2 * left @ c.T).argmin(1)
            n = np.bincount(near, minlength=k)
            sums = np.zeros_like(c)
            np.add.at(sums, near, left)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], left[rng.choice(len(left), k)])
        near = ((c**2).sum(1) - 2 * left @ c.T).argmin(1)
        left = left - c[near]
        out.append(c.astype(np.float32))
    out = np.array(out)
    for _ in range(rounds):  # codes by beam search, then each codebook in turn set to the mean of what it has to add
        codes = beam_encode(x, out, 4)
        left = x - sum(out[m][codes[:, m]] for m in range(books))
        for m in range(books):
            left += out[m][codes[:, m]]
            n = np.bincount(codes[:, m], minlength=k)[:, None]
            sums = np.zeros_like(out[m])
            np.add.at(sums, codes[:, m], left)
            out[m] = np.where(n > 0, sums / np.maximum(n, 1), out[m])
            left -= out[m][codes[:, m]]
    return out


def _blocks(n: int, size: int) -> int:
    return max(1, math.ceil(n / size))


def search(vectors: DataFrame, queries_every: int = 20, k: int = 20, rerank: int = 64, exact: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for each query row, ties to smaller ids.

    Queries are rows whose vec_id is divisible by `queries_every`; candidates are all rows but the query's own.
    Rows with a null id, a null, empty or zero vector, or a null or non-finite component take no part. Equal
    vectors are searched once (known by a 64-bit hash) and expanded to their k + 1 smallest ids, which is all a
    query can return of them. A vec_id with several vectors is as many rows: each is a candidate, for the others
    of its id too, and each is a query with a list of its own; equal rows are one. Vectors of another length
    than the commonest (the longest of those) take no part. Empty tables give an empty result. Extra columns are
    never read. Scores are double precision on the vectors as they are, summed in order; only codes and tables are float.

    The `rerank` best codes a query and block are looked at first, then all whose bound admits a product as large as
    the best found: how good the codes are decides on the work, not on the result. With `exact` no codes are made:
    blocks of queries meet blocks of all vectors.
    """
    import numpy as np

    spark = vectors.sparkSession
    kind = np.float32 if dict(vectors.dtypes)["embedding"] == "array<float>" else np.float64  # as vectors are packed
    e = F.col("embedding")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & e.isNotNull() & sound & F.exists(e, lambda x: x != 0))
    raw = cut(rows.distinct(), "ann-rows")
    usual = raw.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("c"), F.max(F.array_max(F.transform("embedding", F.abs))).alias("top")).orderBy(F.desc("c"), F.desc("d")).first()
    # floats hold no very large or small numbers; a power of two changes neither the order of products nor ties
    unit = 2.0 ** np.floor(np.log2(usual["top"])) if usual and not 1e-12 < usual["top"] < 1e12 else 1.0
    rows = raw.where(F.size("embedding") == usual["d"]) if usual else raw
    distinct = cut(rows.groupBy("embedding").agg(F.min(F.xxhash64("embedding")).alias("rep"), F.min("vec_id").cast("long").alias("least")), "ann-distinct")
    members = cut(rows.select("vec_id", F.xxhash64("embedding").alias("rep")), "ann-members")
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    n = distinct.count()
    if not n:
        return empty
    d = usual["d"]
    first = Window.partitionBy("rep").orderBy("vec_id")
    smallest = members.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1).select("rep", "vec_id")
    if exact:
        books = np.zeros((0, 1, d), np.float32)
    else:
        sample = distinct.orderBy(F.xxhash64("rep"), "rep").limit(TRAIN).toPandas()
        books = train_books(_matrix(sample["embedding"], unit))
        del sample

    def encode(batches):
        import numpy as np

        for pdf in batches:
            if not len(pdf):
                continue
            whole = np.array(list(pdf["embedding"]), float).reshape(len(pdf), -1)
            pdf = pdf.assign(vector=[v.astype(kind).tobytes() for v in whole], code=b"", scale=np.float32(0), left=np.float64(0))
            if not exact:
                x = whole / unit
                codes = beam_encode(x.astype(np.float32), books)
                told = sum(books[m][codes[:, m]].astype(float) for m in range(len(books)))
                norm = (told**2).sum(1)
                scale = np.where(norm > 0, (x * told).sum(1) / np.where(norm > 0, norm, 1), 0).astype(np.float32)
                # what the scaled code leaves of the vector, and what sums in float may be off by for a query of length 1
                off = (d + len(books) + 8) * 2.0**-23 * np.abs(scale) * sum(np.linalg.norm(books[m].astype(float), axis=1)[codes[:, m]] for m in range(len(books)))
                left = np.linalg.norm(x - scale[:, None].astype(float) * told, axis=1) * (1 + 1e-9) + off
                pdf = pdf.assign(code=[c.tobytes() for c in codes], scale=scale, left=left)
            yield pdf[["rep", "least", "vector", "code", "scale", "left"]]

    coded = distinct.mapInPandas(encode, "rep bigint, least bigint, vector binary, code binary, scale float, left double")
    cores = spark.sparkContext.defaultParallelism
    n_code = max(_blocks(n, min(CODE_BLOCK, max(256, BLOCK_BYTES // (8 * d)))), min(2 * cores, _blocks(n, 512)))
    asked = members.where(F.col("vec_id") % queries_every == 0)
    q = cut(distinct.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "embedding"), "ann-queries")
    n_pass = _blocks(q.count(), max(1, PASS_BYTES // (8 * d)))

    def pack_codes(pdf):
        import numpy as np
        import pandas as pd

        numbers = {f"{c}s": [pdf[c].to_numpy(t).tobytes()] for c, t in (("rep", np.int64), ("least", np.int64), ("scale", np.float32), ("left", np.float64))}
        return pd.DataFrame({"cblock": pdf["cblock"].iloc[:1].to_numpy(), "vectors": [b"".join(pdf["vector"])], "codes": [b"".join(pdf["code"])], **numbers})

    blocks = coded.withColumn("cblock", F.pmod(F.xxhash64("rep"), F.lit(n_code)).cast("int")).groupBy("cblock").applyInPandas(pack_codes, "cblock int, vectors binary, codes binary, reps binary, leasts binary, scales binary, lefts binary")
    packed = cut(blocks, "ann-blocks")
    tasks = 8 * cores  # a task has several blocks where there are many, and sends the best of all

    def scan(asked):
        def run(batches):
            import numpy as np
            import pandas as pd

            all_reps, all_vectors = asked.value
            best_of: dict = {}  # of each block of queries, the best of the task's blocks so far: query, score, least, rep
            for pdf in batches:
                for r in pdf.itertuples():
                    reps, leasts, left = np.frombuffer(r.reps, np.int64), np.frombuffer(r.leasts, np.int64), np.frombuffer(r.lefts)
                    x = np.frombuffer(r.vectors, kind).reshape(len(reps), d).astype(float) / unit
                    margin = 16 * d * 2.0**-52 * np.linalg.norm(x, axis=1).max()  # of sums in another order
                    for start in range(0, len(all_reps), QUERY_BLOCK):
                        qs = all_vectors[start : start + QUERY_BLOCK] / unit
                        long = np.linalg.norm(qs, axis=1)
                        none = np.zeros(0, np.int64)
                        found = best_of.get(start, (none, np.zeros(0), none, none))
                        if exact:
                            best_of[start] = _better(found, np.ones((len(reps), len(qs)), bool), x, qs, leasts, reps, margin * long, k + 1)
                            continue
                        codes, score = np.frombuffer(r.codes, np.uint8).reshape(len(reps), -1), np.zeros((len(reps), len(qs)), np.float32)
                        for m, book in enumerate(books):
                            score += (book @ qs.T.astype(np.float32))[codes[:, m]]
                        score *= np.frombuffer(r.scales, np.float32)[:, None]
                        keep = min(rerank, len(reps))
                        some = np.zeros(score.shape, bool)
                        np.put_along_axis(some, np.argpartition(-score, keep - 1, axis=0)[:keep], True, axis=0)
                        found = _better(found, some, x, qs, leasts, reps, margin * long, k + 1)
                        rest = (score + left[:, None] * long >= _last(found, len(qs), k + 1) - margin * long) & ~some
                        best_of[start] = _better(found, rest, x, qs, leasts, reps, margin * long, k + 1)
            for start, (query, score, least, rep) in best_of.items():
                yield pd.DataFrame({"qrep": all_reps[start + query], "crep": rep, "least": least, "score": score * unit * unit})

        return run

    nearest, parts = Window.partitionBy("qrep").orderBy(F.desc("score"), "least", "crep"), []
    for i in range(n_pass):  # queries come to the codes, PASS_BYTES of them at a time
        part = q.where(F.pmod(F.xxhash64("rep", F.lit(7)), F.lit(n_pass)) == i).toPandas()
        if not len(part):
            continue
        asked_reps, asked_vectors = part["rep"].to_numpy(np.int64), np.array(list(part["embedding"]), float)
        # queries of a block are alike, so that the same codes come into question for them
        like = (asked_vectors / unit @ books[0].T).argmax(1) if len(books) else np.zeros(len(part))
        order = np.lexsort((asked_reps, like))
        asked_now = spark.sparkContext.broadcast((asked_reps[order], asked_vectors[order]))
        hits = packed.repartition(min(n_code, tasks), "cblock").mapInPandas(scan(asked_now), "qrep bigint, crep bigint, least bigint, score double")
        parts.append(cut(hits.withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") <= k + 1).select("qrep", "crep", "score"), "ann-found"))
        asked_now.unpersist()
    drop(raw, distinct, q, packed)
    if not parts:
        return empty
    found = reduce(DataFrame.unionByName, parts)
    wide = found.join(smallest.withColumnRenamed("rep", "crep"), "crep")
    order = Window.partitionBy("qrep").orderBy(F.desc("score"), "vec_id", "crep")
    wide = wide.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
    lists = wide.groupBy("qrep").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("m"), "vec_id", "crep"))).alias("l"))  # k + 1 at most
    own = asked.select(F.col("vec_id").alias("query_id"), F.col("rep").alias("qrep")).join(lists, "qrep")
    best = F.slice(F.filter("l", lambda x: (x["vec_id"] != F.col("query_id")) | (x["crep"] != F.col("qrep"))), 1, k)
    out = own.select("query_id", F.posexplode(best).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.m")).alias("score"))


def _last(found, queries: int, k: int):
    """The k-th best score of each query so far, -inf of those with fewer."""
    import numpy as np

    query, score, _, _ = found  # by query, the best first
    out, ends = np.full(queries, -np.inf), np.cumsum(np.bincount(query, minlength=queries))
    full = np.diff(ends, prepend=0) >= k
    out[full] = score[ends[full] - 1]
    return out


def _better(found, mask, x, qs, leasts, reps, margin, k: int):
    """The k best of each query (larger products, then smaller ids) among those found and the pairs of `mask` (rows of x
    by queries). A matrix product tells which pairs come into question; their products are summed in order."""
    import numpy as np

    at = np.flatnonzero(mask.any(1))
    if not len(at):
        return found
    near = x[at] @ qs.T
    near[~mask[at]] = -np.inf
    least = _last(found, len(qs), k)
    if len(at) >= k:
        least = np.maximum(least, np.partition(near, len(at) - k, axis=0)[len(at) - k])
    row, query = np.nonzero((near >= least - margin) & mask[at])
    score = np.zeros(len(row))
    for start in range(0, len(row), PAIRS):
        own, asked = at[row[start : start + PAIRS]], query[start : start + PAIRS]
        for j in range(x.shape[1]):
            score[start : start + PAIRS] += x[own, j] * qs[asked, j]
    query, score, least, rep = (np.concatenate(two) for two in zip(found, (query, score, leasts[at[row]], reps[at[row]]), strict=True))
    order = np.lexsort((rep, least, -score, query))
    starts = np.cumsum(np.bincount(query, minlength=len(qs))) - np.bincount(query, minlength=len(qs))
    order = order[np.arange(len(order)) - starts[query[order]] < k]
    return query[order], score[order], least[order], rep[order]


def _matrix(column, unit: float):
    import numpy as np

    return (np.array(list(column), float).reshape(len(column), -1) / unit).astype(np.float32)


def op8_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


QUERIES = {"op8_additive_quantisation": op8_additive_quantisation}
ORACLE: dict[str, str] = {}
