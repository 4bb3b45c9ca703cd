"""A corpus in blocks, each with the dictionary of its distinct entries, and looking those up in a corpus-wide table.

A block is one row: what is known of its documents, coded by places in the block's dictionary. A table of the whole
corpus is brought to it by one join on distinct entries, so that a frequent entry moves once for each block and not
once for each occurrence; neither the table nor a document's occurrences are ever in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text bytes of a block; one longer document is a block of its own.
BLOCK = 8 << 20


#: Bits of a value, and of an entry's place, in a number that holds both.
VALUE_BITS, PLACE_BITS = 37, 26


def block_ids():
    """Numbers of a task's blocks, one after the other: small ones, as each entry carries its block's."""
    from pyspark import TaskContext

    n = TaskContext.get().partitionId() << 20
    while True:
        yield n
        n += 1


def look_up(blocks: DataFrame, entries: str, table: DataFrame, value: Column) -> DataFrame:
    """`blocks` (block, .., entries: array) with `found`: the value of each entry, in the array's order.

    `table` has the column `key`; `value` is an expression over `key` and the table's other columns, which are null
    for an entry that isn't there; it is a whole number between -2^36 and 2^36, else the job fails. The array itself
    is left out of the result. Every entry has one row per block; on its way back it is one number.
    """
    half = 1 << (VALUE_BITS - 1)
    listed = blocks.select("block", F.posexplode(entries).alias("at", "key"))
    listed = listed.select((F.shiftleft("block", PLACE_BITS) + F.col("at")).alias("slot"), "key")
    valued = listed.join(table, "key", "left").select("slot", value.cast("long").alias("v"))
    fits = F.when(F.abs("v") < half, F.col("v") + half).otherwise(F.raise_error(F.lit("a looked-up value is too large")))
    place = F.col("slot").bitwiseAND((1 << PLACE_BITS) - 1)
    both = valued.select(F.shiftright("slot", PLACE_BITS).alias("block"), (F.shiftleft(place, VALUE_BITS) + fits).alias("x"))
    values = F.transform(F.sort_array(F.collect_list("x")), lambda x: x.bitwiseAND((1 << VALUE_BITS) - 1) - half)
    found = both.groupBy("block").agg(values.alias("found"))
    return blocks.drop(entries).join(found, "block", "left")


def pack(*arrays) -> bytes:
    """Unsigned integers, compressed byte place by byte place: each array after its length."""
    import numpy as np
    import pyarrow as pa

    raw = b"".join(len(a).to_bytes(8, "little") + np.asarray(a).astype("<u4").view("u1").reshape(-1, 4).T.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(raw, asbytes=True)


def unpack(data: bytes) -> list:
    import numpy as np
    import pyarrow as pa

    raw, out, at = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True), [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        planes = np.frombuffer(raw, "u1", 4 * n, at + 8).reshape(4, n)
        out.append(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64))
        at += 8 + 4 * n
    return out


def spans(starts, counts):
    """The places starts[i] .. starts[i] + counts[i] - 1 for each i in turn, as one array."""
    import numpy as np

    ends = np.cumsum(counts)
    out = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    some = counts > 0
    first, begin, n = (ends - counts)[some], starts[some], counts[some]
    if len(first):
        out[first[0]] = begin[0]
        out[first[1:]] = begin[1:] - (begin[:-1] + n[:-1]) + 1
    return np.cumsum(out)
