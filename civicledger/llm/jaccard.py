"""Exact n-gram Jaccard join as a metric-space join.

Jaccard distance is a metric, but between unrelated texts it is 1, and so is the distance to any pivot that is
a document: regions around such pivots hold everything. So there are two levels of pivots.

* Regions: every shingle is a pivot, the set of it alone. A document is at distance 1 - 1/n from its own
  shingles and at 1 from all others; its home is the rarest one, and as a boundary document it is replicated
  into the regions of its next ones for as long as a link from there is possible, which are
  n - ceil(0.8 n) + 1 regions in all. In a region, the place of the pivot in a document's order bounds what it
  can share with others there, and so the sizes of its partners: the window outside of which nothing is paired.
  Rareness is a count of all shingles in a table of fixed size; any order gives the same links. Where the
  table is too full to tell a common shingle from the rest and a region grows large by that, the region's
  shingle is put last in the order and the regions are formed anew.
* Within a region, documents are pivots. The first is the one whose pivot comes earliest in its order, that is
  the one with the least of its own beside what the region shares. Pairs of pivot and member that pass the
  windows are verified on whole sets, and components are built. Members with a possible partner in another
  component stay and go on with the next pivots, until there is none.

Equal sets are one class from the start. A group of near copies is settled by its first pivot; it is never
paired with itself.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, power_table, small, table, text_batches, text_buffer
from .components import components

SHINGLE, PERCENT = 5, 80
COUNTERS = 1 << 22
CHUNKS = 64
#: Members beyond which a region is formed anew if the counters hid how common its shingle is.
HEAVY = 1000
#: Shingles that are put last at most in one turn (the most common ones first).
DEMOTED = 1 << 20
#: Bits of the table that tells which shingles are put last: 8 MB, whatever the corpus. Shingles that share a bit share
#: that fate, which changes the order, the same for all documents, and no result.
HIDDEN = 1 << 26
#: Pivots of a region in each turn after the first.
PIVOTS = 32
_BLOCK = 1 << 19


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def shingle_sets(raw, offsets, width: int = SHINGLE):
    """(document, hash) of the distinct shingles of concatenated texts, sorted by document and hash."""
    import numpy as np

    n_docs = len(offsets) - 1
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if not len(raw):
        return none
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    space = np.zeros(256, bool)
    space[[0x20, 9, 10, 11, 12, 13]] = True
    value = np.random.default_rng(31).integers(1, 2**63, 256, dtype=np.uint64)
    value[space] = 0
    up, down = power_table(len(raw) + 1)
    word = ~space[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts_of_docs = offsets[:-1][offsets[:-1] < len(raw)]
    first[starts_of_docs] = word[starts_of_docs]
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(begin):
        return none
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[lower[raw]] * up[: len(raw)], dtype=np.uint64)])
    words = _mix((sums[end] - sums[begin]) * down[begin])
    doc_of_word = np.searchsorted(offsets, begin, side="right") - 1
    count = np.bincount(doc_of_word, minlength=n_docs)
    at = np.cumsum(count) - count
    # every word starts a shingle if enough words follow in its document; short documents have one of all words
    place = np.arange(len(words)) - at[doc_of_word]
    short = count < width
    full = (count[doc_of_word] - place >= width) | (short[doc_of_word] & (place == 0))
    where = np.flatnonzero(full)
    doc = doc_of_word[where]
    total = np.zeros(len(where), np.uint64)
    for j in range(width):
        inside = place[where] + j < count[doc]
        total += np.where(inside, words[np.minimum(where + j, len(words) - 1)] * np.uint64(pow(0xC2B2AE3D27D4EB4F, j + 1, 1 << 64)), np.uint64(0))
    total = _mix(total + np.minimum(count[doc], width).astype(np.uint64))
    order = np.lexsort((total, doc))
    doc, total = doc[order], total[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (total[1:] != total[:-1])
    return doc[new], total[new]


def _spans(doc, n_docs: int):
    import numpy as np

    n = np.bincount(doc, minlength=n_docs).astype(np.int64)
    return n, np.cumsum(n) - n


def _class_id(own) -> int:
    """64 bits of a digest of a sorted set."""
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def _describe(docs: DataFrame) -> DataFrame:
    """A row (doc_id, n, cls) for each document, and at each task's end its shingle counts (chunk, counts)."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kinds, id_type, counts = [pa.int64(), pa.int64(), pa.int32(), pa.binary()], None, np.zeros(COUNTERS, np.uint32)
        names = ["doc_id", "n", "cls", "chunk", "counts"]
        for batch in text_batches(batches, _BLOCK):
            id_type = batch.column(0).type
            raw, off = text_buffer(batch.column(1))
            doc, sh = shingle_sets(raw, off)
            n, at = _spans(doc, batch.num_rows)
            seen, times = np.unique(_slots(sh, COUNTERS), return_counts=True)
            counts[seen] += times.astype(np.uint32)
            cls = [_class_id(sh[a : a + k]) if k else None for a, k in zip(at, n, strict=True)]
            none = [None] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip((n, cls, none, none), kinds, strict=True))], names)
        if id_type is not None:
            size = COUNTERS // CHUNKS
            for i in range(CHUNKS):
                part = np.minimum(counts[i * size : (i + 1) * size], 65535).astype(np.uint16).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([None], id_type), *(pa.array([x], k) for x, k in zip((None, None, i, part), kinds, strict=True))], names)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, n bigint, cls bigint, chunk int, counts binary")


def _slots(sh, counters: int):
    """Which of the counters (a power of two) is each shingle's."""
    import numpy as np

    return (sh >> np.uint64(65 - counters.bit_length())).astype(np.int64)


def _is_hidden(bits, sh):
    at = _slots(sh, HIDDEN)
    return (bits[at >> 3] >> (at & 7).astype("u1")) & 1


def _hide(bits, sh) -> None:
    import numpy as np

    at = _slots(sh, HIDDEN)
    np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def _levels(described: DataFrame):
    """How common each counter's shingles are, as a byte (8 steps for each doubling), and the mean count.

    A table of fixed size: the counts of all tasks are added up chunk by chunk, as they come in, in the tasks.
    """
    import numpy as np

    def add(batches):
        import numpy as np
        import pyarrow as pa

        sums = {}
        for batch in batches:
            for chunk, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = np.frombuffer(part.as_buffer(), np.uint16)
                sums[chunk] = sums.get(chunk, 0) + counts.astype(np.uint64)
        for chunk, total in sums.items():
            level = np.clip(8 * np.log2(np.maximum(total, 1)), 0, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([level.tobytes()]), pa.array([int(total.sum())])], ["chunk", "levels", "total"])

    counts = described.where("chunk is not null").select("chunk", "counts").repartition(CHUNKS, "chunk")
    out, total = np.zeros((CHUNKS, COUNTERS // CHUNKS), np.uint8), 0
    for r in counts.mapInArrow(add, "chunk int, levels binary, total bigint").collect():  # CHUNKS rows, COUNTERS bytes in all
        out[r["chunk"]] = np.frombuffer(r["levels"], np.uint8)
        total += r["total"]
    return out.ravel(), total / COUNTERS


def _cells(docs: DataFrame, levels, last) -> DataFrame:
    """(cell, cls, n, i): each document's class in the regions of its rarest shingles, i of which are rarer than this."""
    sc = docs.sparkSession.sparkContext
    shared, common = sc.broadcast(levels), sc.broadcast(last)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        level_of, last = shared.value, common.value
        for batch in text_batches(batches, _BLOCK):
            raw, off = text_buffer(batch.column(0))
            doc, sh = shingle_sets(raw, off)
            n, at = _spans(doc, batch.num_rows)
            cls = np.array([_class_id(sh[a : a + k]) if k else 0 for a, k in zip(at, n, strict=True)], np.int64)
            level = level_of[_slots(sh, len(level_of))].astype(np.int16)
            level += 256 * _is_hidden(last, sh).astype(np.int16)
            order = np.lexsort((sh, level, doc))
            rank = np.arange(len(doc)) - at[doc]
            keep = rank < (n - (n * PERCENT + 99) // 100 + 1)[doc]
            d = doc[keep]
            yield pa.RecordBatch.from_arrays([pa.array(sh[order][keep].view(np.int64)), pa.array(cls[d]), pa.array(n[d].astype(np.int32)), pa.array(rank[keep].astype(np.int32))], ["cell", "cls", "n", "i"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "cell bigint, cls bigint, n int, i int")


def _regions(docs: DataFrame, described: DataFrame) -> DataFrame:
    """(cell, cls, n, i, p, pn, pi): the members of the regions of two or more classes, with the region's first pivot p."""
    import numpy as np

    levels, mean = _levels(described)
    last = np.zeros(HIDDEN // 8, np.uint8)
    while True:
        cells = cut(_cells(docs, levels, last), "jaccard-cells")
        shared = cells.groupBy("cell").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo != hi").select("cell")
        members = cut(cells.join(shared, "cell").distinct(), "jaccard-members")
        drop(cells)
        if 4 * mean <= HEAVY:
            break
        sizes = members.groupBy("cell").agg(F.count("*").alias("rows")).where(F.col("rows") > HEAVY)
        found = sizes.orderBy(F.desc("rows"), "cell").select("cell").limit(DEMOTED).toArrow()
        found = np.asarray(found.column(0), np.int64).view(np.uint64)
        hidden = found[(levels[_slots(found, len(levels))] <= 8 * np.log2(4 * mean)) & (_is_hidden(last, found) == 0)]
        if not len(hidden):
            break
        _hide(last, hidden)
        drop(members)
    first = members.groupBy("cell").agg(F.min(F.struct("i", "n", "cls")).alias("first"))
    with_pivot = cut(members.join(first, "cell").select(*members.columns, F.col("first.cls").alias("p"), F.col("first.n").alias("pn"), F.col("first.i").alias("pi")), "jaccard-members", members.count())
    drop(members)
    return with_pivot


def _own_texts(texts: DataFrame) -> DataFrame:
    """Rows of (cls, text) whose text is of that class."""

    def run(batches):
        import pyarrow as pa

        for batch in text_batches(batches, _BLOCK):
            doc, sh = shingle_sets(*text_buffer(batch.column(1)))
            n, at = _spans(doc, batch.num_rows)
            own = [k > 0 and _class_id(sh[a : a + k]) == c for a, k, c in zip(at, n, batch.column(0).to_pylist(), strict=True)]
            yield batch.filter(pa.array(own, pa.bool_()))

    return texts.mapInArrow(run, "cls bigint, text string")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of (a, b) whose whole sets link; texts (cls, text) travel, being smaller than their sets."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def sets(column):
            """(number of each row's text, sets of the distinct texts)"""
            coded = pa.concat_arrays([column]).dictionary_encode()
            doc, sh = shingle_sets(*text_buffer(coded.dictionary))
            n, at = _spans(doc, len(coded.dictionary))
            return coded.indices.to_numpy(), [sh[s : s + k] for s, k in zip(at, n, strict=True)]

        for batch in batches:
            ends = np.cumsum(np.asarray(pc.add(pc.binary_length(batch.column(2)), pc.binary_length(batch.column(3)))).astype(np.int64))
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + 2 * _BLOCK, side="right")))
                part, start = batch.slice(start, stop - start), stop
                (i, x), (j, y) = sets(part.column(2)), sets(part.column(3))
                keep = []
                for p, q in zip(i, j, strict=True):
                    same = len(np.intersect1d(x[p], y[q], assume_unique=True))
                    keep.append(100 * same >= PERCENT * (len(x[p]) + len(y[q]) - same))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # where the pairs are few enough to be broadcast, only texts that occur in one are moved
    pairs = small(pairs)
    firsts = texts.select(F.col("cls").alias("a"), F.col("text").alias("x")).join(pairs.select("a"), "a", "left_semi")
    both = texts.select(F.col("cls").alias("b"), F.col("text").alias("y")).join(pairs, "b").join(firsts, "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _most(n, i):
    """The size beyond which no set shares enough with one of n shingles that share nothing of their first i."""
    return F.floor((100 * n.cast("long") - (100 + PERCENT) * i.cast("long")) / PERCENT)


def _fit(n, i, m, j):
    """Whether sets of n and m shingles may link that share nothing of their first i and j."""
    return (m <= _most(n, i)) & (n <= _most(m, j))


def _unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (cell, cls, n, i, comp) that have a possible partner in their region and in another component."""
    m = members.select("cell", "cls", "n", "i").join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    m = m.withColumn("most", _most(F.col("n"), F.col("i")).cast("int"))
    # the least size and the widest window in the region, and in the components but the one that has these
    best = m.groupBy("cell").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct("n", "comp")).alias("s"), F.max(F.struct("most", "comp")).alias("w"))
    m = m.join(best.where("lo != hi").drop("lo", "hi"), "cell")
    second = m.groupBy("cell").agg(F.min(F.when(F.col("comp") != F.col("s.comp"), F.col("n"))).alias("s2"), F.max(F.when(F.col("comp") != F.col("w.comp"), F.col("most"))).alias("w2"))
    m = m.join(second, "cell")
    least = F.when(F.col("comp") == F.col("s.comp"), F.col("s2")).otherwise(F.col("s.n"))
    widest = F.when(F.col("comp") == F.col("w.comp"), F.col("w2")).otherwise(F.col("w.most"))
    return m.where((least <= F.col("most")) & (widest >= F.col("n"))).select("cell", "cls", "n", "i", "comp")


def _with_pivots(members: DataFrame, turn: int) -> DataFrame:
    """Members with their region's next pivots, an array of at most PIVOTS: the first of each hash class."""
    group = F.pmod(F.xxhash64("cls", F.lit(turn)), F.lit(PIVOTS))
    firsts = members.groupBy("cell", group.alias("g")).agg(F.min(F.struct("i", "n", "cls", "comp")).alias("first"))
    return members.join(firsts.groupBy("cell").agg(F.collect_list("first").alias("pivots")), "cell")


def _both(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _linked(pairs: DataFrame, most: int | None, classes: DataFrame, docs: DataFrame, repeated: bool) -> DataFrame:
    """Those of the pairs (a, b) of classes, `most` at most, that link, by the texts of one document of each class."""
    pairs = cut(pairs, "jaccard-pairs", most)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    wanted = cut(classes.join(ids, "cls", "left_semi").select("cls", F.col("rep").alias("_rep")), "jaccard-wanted", 2 * pairs.count())
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(small(wanted), F.col("doc_id").eqNullSafe(F.col("_rep"))).select("cls", "text")
    # a repeated id may bring a class several texts, others' among them
    texts = cut(_own_texts(texts).dropDuplicates(["cls"]) if repeated else texts, "jaccard-texts")
    found = cut(_verified(pairs, texts), "jaccard-links")
    drop(pairs, wanted, texts)
    return found


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp) after `links` between nodes of several components."""
    for end in ("a", "b"):
        links = links.join(labels.select(F.col("node").alias(end), F.col("comp").alias("_c")), end, "left").withColumn(end, F.coalesce("_c", end)).drop("_c")
    step = components(links)
    moved = labels.join(step.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    out = cut(moved.union(step.select("node", "comp")).distinct(), "jaccard-labels", labels.count() + step.count())
    drop(labels, step)
    return out


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, cls, component_id: one row for each document.

    ASCII letters are lower-cased; words are runs of anything but ASCII white space; a set holds the distinct
    5-word shingles (of fewer words, the sequence). Two documents link when 100 * common >= 80 * united;
    component_id is the smallest doc_id reachable by links. Null and wordless texts have no shingle and are a
    component each. Equal texts link however many they are; repeated rows are equal texts; extra columns are
    never read; an empty table gives an empty result. A very long text is one row of as many shingles as it has
    words. Shingles are 64-bit hashes, and sets are equal if 64 bits of their digests are.
    """
    described = cut(_describe(docs.select("doc_id", "text")), "jaccard-described")
    known = described.where("chunk is null").select("doc_id", "n", "cls")
    n_docs = known.count()
    classes = cut(known.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep")), "jaccard-classes", n_docs)
    repeated = not known.groupBy("doc_id").count().where("count > 1").isEmpty()
    members = _regions(docs, described)
    near = members.where((F.col("cls") != F.col("p")) & _fit(F.col("n"), F.col("i"), F.col("pn"), F.col("pi")))
    links = _linked(near.select(*_both(F.col("cls"), F.col("p"))).distinct(), members.count(), classes, docs, repeated)
    labels = components(links)
    before, members = members, cut(_unsettled(members.where("cls != p"), labels), "jaccard-members", members.count())
    drop(before, links)
    turn = 0
    while not members.isEmpty():
        met = cut(_with_pivots(members, turn), "jaccard-met", members.count())
        own = lambda q: (q["comp"] != F.col("comp")) & _fit(F.col("n"), F.col("i"), q["n"], q["i"])
        pairs = met.select("cls", F.explode(F.filter("pivots", own)).alias("q")).select(*_both(F.col("cls"), F.col("q.cls"))).distinct()
        links = _linked(pairs, None, classes, docs, repeated)
        labels = _relabelled(labels, links)
        rest = met.where(~F.exists("pivots", lambda q: q["cls"] == F.col("cls")))
        before, members = members, cut(_unsettled(rest, labels), "jaccard-members", members.count())
        drop(before, met, links)
        turn += 1
    full = known.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    full = cut(full.select("doc_id", "n", "cls", "comp"), "jaccard-labelled", n_docs)
    least = cut(full.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id")), "jaccard-least", n_docs)
    drop(described, classes, labels, members)
    out = full.join(least, "comp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "cls", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` without the documents that are linked, directly or through others, to one of a smaller id.

    Rows of null id, and texts without a word, stay; rows that repeat an id share one fate; an empty table stays
    empty, and no column's name can clash.
    """
    chosen = jaccard_components(docs)
    gone = chosen.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    kept = row.join(gone, F.col("_row.doc_id") == F.col("_gone"), "left_anti")
    return kept.select(*[F.col(f"_row.`{c}`") for c in docs.columns])


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op5_ngram_jaccard": op5_ngram_jaccard}
ORACLE: dict[str, str] = {}
