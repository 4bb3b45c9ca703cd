"""An inverted file of vectors: coarse centroids, vectors stored by list, a few lists probed for each query.

A list's vectors are stored in packed chunks, and queries go to the lists in packed groups: a chunk and a group are one
row of an equi-join and one matrix product, so that no row is made for a pair of vectors. Such rows take megabytes, and
Spark's readers and hash aggregates bound rows by their number: chunks are packed by workers, one at a time, and stored
in row groups of few rows, which is what a reader unpacks at once. Each list also keeps its
reach, the least cosine between its centroid and a member. By the triangle inequality of angles it bounds what a list
that wasn't probed can hold, and `exact` probes those, and only those, that could hold something nearer.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import shared_folder, stored

LISTS = 100
PROBES = 8
#: Vectors that the centroids are fitted to at most: those of the smallest hashes of their ids.
SAMPLE = 20_000
#: Vectors of a stored chunk: 2 MB of 256 components.
CHUNK = 1024
#: Chunks of a list that one copy of a group of queries meets.
SPAN = 16
#: Chunks of a row group of the stored table: files compress well, and bytes on disk are no bound.
STORED = 8
#: Bytes of an Arrow batch on its way to a Python worker: rows are packed, and 10,000 of them are no bound.
BATCH_BYTES = 8 << 20


def unit_rows(column):
    """Places and unit vectors (float64) of an Arrow list column's rows, without the null, zero and not finite ones.

    Rows of another length than the first usable one can't be compared with it, and are an error.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    flat = pc.fill_null(column.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)  # null as not finite
    at = np.flatnonzero(n)
    if len(set(n[at].tolist())) == 1:
        rows = flat.reshape(len(at), -1)
    else:  # those of other lengths must all be unusable
        some = [(i, x) for i, x in zip(at, np.split(flat, np.cumsum(n[at])[:-1]), strict=True) if 0 < np.linalg.norm(x) < np.inf] if len(at) else []
        at, rows = np.array([i for i, _ in some], np.int64), np.array([x for _, x in some]) if some else np.zeros((0, 0))
    size = np.linalg.norm(rows, axis=1)
    good = (size > 0) & (size < np.inf)
    return (at[good], rows[good] / size[good][:, None]) if good.any() else (np.zeros(0, np.int64), np.zeros((0, 0)))


def fit(sample, lists: int, rounds: int = 8):
    """Unit centroids of unit vectors: each is the direction of the sum of those nearest to it."""
    import numpy as np

    if not len(sample):
        return np.zeros((1, 0))
    k = min(lists, len(sample))
    out = sample[np.random.default_rng(5).permutation(len(sample))[:k]].copy()
    for _ in range(rounds):
        near = (sample @ out.T).argmax(1)
        sums = np.zeros_like(out)
        np.add.at(sums, near, sample)
        norm = np.linalg.norm(sums, axis=1)
        out = np.where(norm[:, None] > 1e-12, sums / np.maximum(norm, 1e-12)[:, None], out)
    return out


@dataclass
class InvertedFile:
    """centroids; by list, the number of its chunks and its reach; table: (list, part, ids, vectors as bytes)."""

    centroids: object
    parts: object
    reach: object
    table: DataFrame
    kind: str

    def _routed(self, queries: DataFrame, probes: int, rest: bool, least: float) -> DataFrame:
        """(list, asked, rows): queries (id, embedding, found) in groups, a row for each list they are to meet.

        A worker holds one group at a time; how many chunks a list has is not its business.
        """
        centroids, parts, reach, kind = self.centroids, self.parts, self.reach, self.kind

        def run(batches):
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                at, rows = unit_rows(batch.column("embedding"))
                if not len(at) or not centroids.shape[1]:
                    continue
                near = rows @ centroids.T
                first = np.zeros(near.shape, bool)
                np.put_along_axis(first, np.argsort(-near, axis=1, kind="stable")[:, :probes], True, axis=1)
                if rest:
                    angle = np.arccos(np.clip(near, -1, 1)) - np.arccos(np.clip(reach, -1, 1))[None]
                    best = np.array([least if x is None else max(x, least) for x in batch.column("found").to_pylist()])[at]
                    first = ~first & (np.cos(np.maximum(angle, 0)) >= best[:, None] - 1e-9)
                ids, types = batch.column("id").to_pylist(), (pa.int32(), pa.list_(batch.schema.field("id").type), pa.binary())
                for k in np.flatnonzero(first.any(0) & (parts > 0)):
                    own = np.flatnonzero(first[:, k])
                    for start in range(0, len(own), CHUNK):
                        group = own[start : start + CHUNK]
                        row = (k, [ids[i] for i in at[group]], rows[group].tobytes())
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], ["list", "asked", "rows"])

        return queries.mapInArrow(run, f"list int, asked array<{kind}>, rows binary")

    def _met(self, groups: DataFrame, least: float) -> DataFrame:
        """(id, near, similarity): for each query and chunk that met, the nearest vector of the chunk."""
        width, kind = self.centroids.shape[1], self.kind

        def multiply(batches):
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                for i in range(batch.num_rows):
                    x, y = (np.frombuffer(batch.column(c)[i].as_buffer()).reshape(-1, width) for c in ("rows", "vectors"))
                    s = np.round(x @ y.T, 12)
                    at = s.argmax(1)  # the first of equals; a chunk's ids ascend
                    most = s[np.arange(len(x)), at]
                    keep = pa.array(np.flatnonzero(most >= least))
                    asked, ids = batch.column("asked").slice(i, 1).flatten(), batch.column("ids").slice(i, 1).flatten()
                    yield pa.RecordBatch.from_arrays([asked.take(keep), ids.take(pa.array(at)).take(keep), pa.array(most).take(keep)], ["id", "near", "similarity"])

        spans = F.element_at(F.array(*[F.lit(max(1, -(-int(n) // SPAN))) for n in self.parts]), F.col("list") + 1)
        sent = groups.withColumn("span", F.explode(F.sequence(F.lit(0), spans - 1)))
        # by the files' size, which is far from that of the rows, the table might be broadcast
        met = sent.join(self.table.withColumn("span", F.floor(F.col("part") / SPAN).cast("int")).hint("merge"), ["list", "span"])
        return met.select("asked", "rows", "ids", "vectors").mapInArrow(multiply, f"id {kind}, near {kind}, similarity double")

    def nearest(self, queries: DataFrame, probes: int = PROBES, least: float = -1.0, exact: bool = False) -> DataFrame:
        """(id, near, similarity) of queries (id, embedding): the most similar stored vector at `least` or above.

        `probes` lists are looked into; with `exact` also each other list whose bound admits a vector that is as near
        as the best one found. Similarities count to 12 places, ties go to the smaller id. Rows without a usable
        vector have no answer, and neither have queries that nothing comes up to.
        """
        queries.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        asked = queries.select("id", "embedding")
        top = lambda df: df.groupBy("id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "near")).alias("m")).select("id", "m.near", (-F.col("m.s")).alias("similarity"))
        found = top(self._met(self._routed(asked.withColumn("found", F.lit(None).cast("double")), probes, False, least), least))
        if not exact or probes >= len(self.parts):
            return found
        found = stored(found, "nearest")
        again = asked.join(found.select("id", F.col("similarity").alias("found")).hint("merge"), "id", "left").select("id", "embedding", "found")
        return top(found.unionByName(self._met(self._routed(again, probes, True, least), least)))


def build(vectors: DataFrame, lists: int = LISTS, sample: int = SAMPLE, path: str | None = None) -> InvertedFile:
    """The inverted file of vectors (id, embedding), written to `path` (by default a table of this session).

    Centroids are fitted to at most `sample` vectors; every vector is stored. Fitting and counting the lists run as
    jobs, as creating an index does; what comes to the driver is bounded by `sample` and `lists`.
    """
    import numpy as np
    import pyarrow as pa

    spark, kind = vectors.sparkSession, dict(vectors.dtypes)["id"]
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    rows = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    usable, hashed = rows.where("embedding is not null"), F.xxhash64("id")
    # the last hash is found first, so that tasks don't each hold and send `sample` vectors
    last = usable.select(hashed.alias("hash")).orderBy("hash").limit(sample).agg(F.max("hash")).first()[0]
    some = usable.where(hashed <= F.lit(last).cast("long")).orderBy(hashed, "id").limit(sample).select("embedding").toArrow()
    parts = [unit_rows(pa.array(c)) for c in some.column(0).chunks]
    parts = [x for _, x in parts if len(x)]
    centroids = fit(np.concatenate(parts) if parts else np.zeros((0, 0)), lists)

    def assign(batches):
        for batch in batches:
            at, own = unit_rows(batch.column("embedding"))
            if not len(at):
                continue
            near = own @ centroids.T
            k = near.argmax(1)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), batch.column("id").take(pa.array(at)), pa.array([x.tobytes() for x in own], pa.binary()), pa.array(near[np.arange(len(k)), k])], ["list", "id", "v", "cosine"])

    listed = rows.mapInArrow(assign, f"list int, id {kind}, v binary, cosine double")
    count, reach = np.zeros(len(centroids), np.int64), np.ones(len(centroids))
    for r in listed.groupBy("list").agg(F.count("*").alias("n"), F.min("cosine").alias("reach")).collect():
        count[r["list"]], reach[r["list"]] = -(-r["n"] // CHUNK), r["reach"]
    of = F.element_at(F.array(*[F.lit(int(n)) for n in np.maximum(count, 1)]), F.col("list") + 1)
    schema = f"list int, part int, ids array<{kind}>, vectors binary"

    def pack(rows):
        import pyarrow.compute as pc

        rows = rows.take(pc.sort_indices(rows, [("id", "ascending")], null_placement="at_start"))
        ids = pa.array([rows["id"].to_pylist()], pa.list_(rows.schema.field("id").type))
        return pa.table({"list": rows["list"][:1], "part": rows["part"][:1], "ids": ids, "vectors": pa.array([b"".join(rows["v"].to_pylist())], pa.binary())})

    chunks = listed.select("list", F.pmod(F.xxhash64("id"), of).cast("int").alias("part"), "id", "v").groupBy("list", "part").applyInArrow(pack, schema)
    path = path or f"{shared_folder(spark)}/lists-{uuid.uuid4().hex[:12]}"
    chunks.write.option("parquet.block.row.count.limit", STORED).parquet(path)
    table = spark.read.schema(schema).parquet(path)
    return InvertedFile(centroids, count, reach, table, kind)
