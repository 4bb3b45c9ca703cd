"""Repeated-substring removal by a distributed difference-cover sort of bounded depth.

A suffix array would order all suffixes; here only their first `least` (200) bytes matter, which bounds the
depth. The difference cover modulo 133 generalises the triples of the modulo-3 scheme: 12 of 133 positions are
sampled, and for any two positions some shift below 133 moves both onto samples. So two equal windows of 200
bytes hold equal sampled tuples of 68 bytes at the same shift:

1. sampled tuples are named (64-bit hashes, sorted and counted by range); names that occur once are settled and
   leave the recursion, as almost all do;
2. repeated names are refined to depth 200: sampled windows that repeat prove the inside of long repeats;
3. names within reach of a window that is neither proven nor excluded are marked, wherever they occur;
4. remaining suffixes are merged: every window (sampled or not) that reaches a marked name is keyed by its 200
   bytes, sorted with all others, and compared with its neighbours in the order.

Each step is one exchange. Blocks of whole documents send their distinct keys, sorted and packed by hash range,
so that a passage of a third of all documents costs a key a block; each range is sorted in one task and answers
with one bit a key. Answers are written to the shared folder by block, and the next pass over the blocks reads
its own. Only keys and bits are shuffled, never text.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import power_table, shared_path, table, text_batches, text_buffer

#: A perfect difference set: each residue modulo 133 but 0 is the difference of one pair.
COVER, MODULUS = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109), 133
BLOCK_BYTES = 2 << 20
RANGE_KEYS = 2_000_000
SHARD = 32


class Hashes:
    """64-bit hashes of windows of a block: prefix sums of a polynomial over random values of byte pairs."""

    def __init__(self, raw):
        import numpy as np

        value = np.random.default_rng(20).integers(1, 2**63, 1 << 16, dtype=np.uint64)
        pairs = raw[:-1].astype(np.uint16) << np.uint16(8) | raw[1:]
        up, self.down = power_table(len(raw) + 1)
        self.sums = np.zeros(max(1, len(raw)), np.uint64)
        np.cumsum(value[pairs] * up[: len(pairs)], out=self.sums[1:])

    def of(self, at, length: int):
        """Of the windows of `length` bytes (two at least) that start at `at`."""
        import numpy as np

        x = (self.sums[at + length - 1] - self.sums[at]) * self.down[at]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
        return x ^ (x >> np.uint64(32))


def _spread(n: int, starts, ends):
    """Booleans of n places, true in any of the intervals [start, end); both ascend."""
    import numpy as np

    mark = np.zeros(n + 1, np.int8)
    if len(starts):
        new = np.ones(len(starts), bool)
        new[1:] = starts[1:] > ends[:-1]
        mark[starts[new]] = 1
        mark[ends[np.append(new[1:], True)]] = -1
    return np.cumsum(mark, dtype=np.int8)[:n].view(bool)


class Keys:
    """The distinct keys of some places of a block, in the order in which they are sent: by range, then by key."""

    def __init__(self, hashes, ranges: int, short: bool):
        import numpy as np

        part = ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)  # ascends with the hash
        low = (part << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)) if short else hashes
        order = np.argsort(low)
        p, k = part[order].astype(np.int64), low[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        self.place = np.empty(len(k), np.int64)  # of each input, its key's number
        self.place[order] = np.cumsum(new) - 1
        self.part, self.key = p[new], k[new].astype(np.uint32 if short else np.uint64)
        self.many = np.bincount(self.place, minlength=len(self.key)) > 1

    def rows(self, block: int, flags):
        """(range, block, keys, flags) for each range that has keys."""
        import numpy as np

        if not len(self.part):
            return
        cuts = np.flatnonzero(np.r_[True, self.part[1:] != self.part[:-1]])
        for a, b in zip(cuts, np.r_[cuts[1:], len(self.part)], strict=True):
            yield int(self.part[a]), block, self.key[a:b].tobytes(), np.packbits(flags[a:b]).tobytes()

    def answers(self, bits: dict[int, bytes]):
        """For each input place, the bit that its key's range answered."""
        import numpy as np

        out = np.zeros(len(self.key), bool)
        if len(self.part):
            cuts = np.flatnonzero(np.r_[True, self.part[1:] != self.part[:-1]])
            for a, b in zip(cuts, np.r_[cuts[1:], len(self.part)], strict=True):
                out[a:b] = np.unpackbits(np.frombuffer(bits[int(self.part[a])], np.uint8), count=b - a).astype(bool)
        return out[self.place]


class Block:
    """One block's places and the four steps, each computed again from the text and the answers so far."""

    def __init__(self, raw, lengths, least: int, ranges: int):
        import numpy as np

        self.raw, self.n, self.least, self.ranges = raw, len(raw), least, ranges
        starts = np.cumsum(lengths) - lengths
        self.at = np.arange(self.n, dtype=np.int32) - np.repeat(starts, lengths).astype(np.int32)
        self.rest = np.repeat(lengths, lengths).astype(np.int32) - self.at
        self.tuple = least - MODULUS + 1
        cover = np.zeros(MODULUS, bool)
        cover[list(COVER)] = True
        self.sample = np.flatnonzero(cover[self.at % MODULUS] & (self.rest >= self.tuple))
        self.hashes = Hashes(raw)

    def step1(self):
        keys = Keys(self.hashes.of(self.sample, self.tuple), self.ranges, True)
        return keys, keys.many

    def step2(self, bits):
        names, _ = self.step1()
        self.repeated = self.sample[names.answers(bits[0])]
        self.deep = self.repeated[self.rest[self.repeated] >= self.least]
        keys = Keys(self.hashes.of(self.deep, self.least), self.ranges, False)
        return keys, keys.many

    def step3(self, bits):
        import numpy as np

        deeper, _ = self.step2(bits)
        proven = self.deep[deeper.answers(bits[1])]
        self.proven = _spread(self.n, proven, proven + self.least)
        s = self.repeated
        near = _spread(self.n, s - np.minimum(MODULUS - 1, self.at[s]), s + 1) & (self.rest >= self.least)
        covered = np.r_[0, np.cumsum(self.proven)]
        p = np.flatnonzero(near)
        p = p[covered[p + self.least] - covered[p] < self.least]
        reach = _spread(self.n, p, np.minimum(p + MODULUS, self.n))
        keys = Keys(self.hashes.of(s, self.tuple), self.ranges, True)
        flags = np.zeros(len(keys.key), bool)
        flags[keys.place[reach[s]]] = True
        return keys, flags

    def step4(self, bits):
        import numpy as np

        names, _ = self.step3(bits)
        marked = self.repeated[names.answers(bits[2])]
        reach = _spread(self.n, marked - np.minimum(MODULUS - 1, self.at[marked]), marked + 1)
        self.last = np.flatnonzero(reach & (self.rest >= self.least))
        keys = Keys(self.hashes.of(self.last, self.least), self.ranges, False)
        return keys, keys.many

    def removed(self, bits):
        windows, _ = self.step4(bits)
        found = self.last[windows.answers(bits[3])]
        return self.proven | _spread(self.n, found, found + self.least)


def _read_bits(folder: str, shard: int, block: int) -> dict[int, bytes]:
    """A block's answers, from its shard of a step's table in the shared folder."""
    import pyarrow.dataset as ds
    from pyarrow import fs as pafs

    fs, path = pafs.FileSystem.from_uri(f"{folder}/shard={shard}")
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return {}
    t = ds.dataset(path, filesystem=fs, format="parquet").to_table(columns=["range", "bits"], filter=ds.field("block") == block)
    return dict(zip(t["range"].to_pylist(), t["bits"].to_pylist(), strict=True))


def _blocks(docs: DataFrame) -> DataFrame:
    """(block, ids, lengths, raw): whole documents, packed to about BLOCK_BYTES."""
    kind = dict(docs.dtypes)["doc_id"]

    def pack(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        seq, ids, lengths, parts, size = TaskContext.get().partitionId() << 32, [], [], [], 0
        names = ["block", "ids", "lengths", "raw"]

        def block():
            return pa.RecordBatch.from_arrays([pa.array([seq], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([lengths], pa.list_(pa.int32())), pa.array([b"".join(parts)], pa.binary())], names)

        for batch in text_batches(batches, BLOCK_BYTES // 4):
            id_type = batch.column(0).type
            raw, off = text_buffer(batch.column(1))
            ids, lengths, parts, size = ids + batch.column(0).to_pylist(), lengths + np.diff(off).tolist(), [*parts, raw.tobytes()], size + len(raw)
            if size >= BLOCK_BYTES or len(ids) >= 50_000:
                yield block()
                seq, ids, lengths, parts, size = seq + 1, [], [], [], 0
        if ids:
            yield block()

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(pack, f"block bigint, ids array<{kind}>, lengths array<int>, raw binary")


def remove_repeats(docs: DataFrame, least: int = 200, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (with `texts` also kept, the remaining bytes).

    A byte of a document's UTF-8 text goes if some `least`-byte string that covers it also starts anywhere
    else, in the same document or another; strings are those of the input, so both copies go. Spans are the
    maximal runs of removed bytes. Null and empty texts, and shorter ones, lose nothing. Repeated rows are
    texts of their own and so copies of each other, equal ids notwithstanding; null ids pass through; extra
    columns are never read; an empty table gives an empty result. Equality is that of 64-bit hashes. A document
    is one block of its task, with some dozens of bytes for each of its bytes: a text of very many bytes needs an
    executor that holds that.
    """
    if least <= MODULUS:
        raise ValueError(f"the strings must be longer than {MODULUS} bytes")
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    path = shared_path(spark, "substring-blocks")
    _blocks(docs).write.option("compression", "zstd").parquet(path)
    blocks = spark.read.parquet(path)
    n_blocks, n_bytes = blocks.agg(F.count("*"), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0))).first()
    ranges = max(8, math.ceil(n_bytes * len(COVER) / MODULUS / RANGE_KEYS))
    shards = max(1, math.ceil(n_blocks / SHARD))
    blocks = blocks.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int"))
    folders: list[str] = []

    def load(row, upto: list[str]):
        import numpy as np

        b = Block(np.frombuffer(row["raw"], np.uint8), np.array(row["lengths"], np.int64), least, ranges)
        return b, [_read_bits(f, row["shard"], row["block"]) for f in upto]

    def rows_of(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.slice(i, 1).to_pylist()[0]

    def send(step: int, upto: list[str]):
        def run(batches):
            import pyarrow as pa

            for row in rows_of(batches):
                b, bits = load(row, upto)
                keys, flags = [b.step1, b.step2, b.step3, b.step4][step](*([bits] if step else []))
                out = list(zip(*keys.rows(row["block"], flags), strict=True))
                if out:
                    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                    shard = pa.array([row["shard"]] * len(out[0]), pa.int32())
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(out, kinds, strict=True)), shard], ["range", "block", "keys", "flags", "shard"])

        return run

    def answer(short: bool, base: int, boost: int):
        def run(pdf):
            import numpy as np

            kind = np.uint32 if short else np.uint64
            sent = [np.frombuffer(x, kind) for x in pdf["keys"]]
            n = [len(x) for x in sent]
            keys = np.concatenate(sent)
            weight = base + boost * np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=k) for f, k in zip(pdf["flags"], n, strict=True)]).astype(np.int64)
            order = np.argsort(keys)
            ordered = keys[order]
            first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
            yes = np.add.reduceat(weight[order], first) >= 2
            out = np.empty(len(keys), bool)
            out[order] = np.repeat(yes, np.diff(np.r_[first, len(keys)]))
            ends = np.cumsum(n)
            return pdf[["range", "block", "shard"]].assign(bits=[np.packbits(out[e - k : e]).tobytes() for e, k in zip(ends, n, strict=True)])

        return run

    for step, (short, base, boost) in enumerate([(True, 1, 1), (False, 1, 1), (True, 0, 2), (False, 1, 1)]):
        sent = blocks.mapInArrow(send(step, list(folders)), "range int, block bigint, keys binary, flags binary, shard int")
        told = sent.groupBy("range").applyInPandas(answer(short, base, boost), "range int, block bigint, shard int, bits binary")
        folder = shared_path(spark, f"substring-bits{step + 1}")
        told.repartition("shard").write.partitionBy("shard").parquet(folder)
        folders.append(folder)

    def finish(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = one.to_pylist()[0]
                b, bits = load(row, folders)
                gone = b.removed(bits)
                lengths = np.array(row["lengths"], np.int64)
                starts = np.cumsum(lengths) - lengths
                total = np.r_[0, np.cumsum(gone)]
                edge = np.r_[0, np.cumsum(gone & ~(np.r_[False, gone[:-1]] & (b.at > 0)))]
                removed, spans = total[starts + lengths] - total[starts], edge[starts + lengths] - edge[starts]
                kept = [b.raw[s : s + n][~gone[s : s + n]].tobytes() if r else row["raw"][s : s + n] for s, n, r in zip(starts, lengths, removed, strict=True)]
                out = [pa.array(row["ids"], one.schema.field("ids").type.value_type), pa.array(lengths), pa.array(removed), pa.array(spans), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                yield pa.RecordBatch.from_arrays(out + ([pa.array(kept, pa.binary())] if texts else []), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * texts)

    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if texts else "")
    return blocks.mapInArrow(finish, schema)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
ORACLE: dict[str, str] = {}
