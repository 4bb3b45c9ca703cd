"""Alignment of two tokenizers: minimal groups of tokens that cover the same bytes, and counts of overlapping pairs.

Tokens of both sides are the nodes of a bipartite graph, with a link for each pair whose byte ranges overlap; its
connected components, found by union-find, are the minimal groups, as a place where both sides end a token is a
place that no link crosses. Members of the components expand to links, and these are counted as id pairs.

A text is cut into chunks at single spaces between other characters, where both tokenizers begin a token; a block
of texts is tokenised and grouped once for each distinct chunk. The pair counts of the whole corpus come back to a
block by a join on its distinct pairs.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import BLOCK, block_ids, look_up, pack, spans, unpack
from .common import cut, drop, table, text_batches, worker_cache

#: Characters on which all regular expression engines agree; chunks of others are left to the tokenizers' own library.
COMMON = re.compile(r"[\x20-\x7E\nÀ-ɏ]*")
#: A space between two characters that aren't white space, for either tokenizer.
CUT = re.compile(r"(?<=\S) (?=\S)")
SHIFT = 16  # bits of a B id within a pair


def byte_table() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies: themselves where printable, else 256 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, with each id's bytes; ids of A from `a_path` (JSON of a byte-level BPE), of B from `b_path` (a piece model)."""

    def __init__(self, a_path: str, b_path: str, pattern: str):
        import numpy as np
        import pyarrow as pa
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, of = spec["model"]["vocab"], byte_table()
        added = {x["content"] for x in spec.get("added_tokens", [])}
        a_bytes = {i: bytes(map(of.__getitem__, t)) for t, i in vocab.items() if t not in added}
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        ranks = {b: i for i, b in a_bytes.items()}
        # ids in order of merges: then they are ranks, and a faster library gives the same ids
        self.fast = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if merged == sorted(merged) and len(ranks) == len(a_bytes) and not spec.get("normalizer") else None
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.whole = any("▁" in p[1:] and p.strip("▁") for p in pieces)  # a piece may cross a space: texts aren't cut
        n = max(max(a_bytes) + 1, len(b_bytes))
        self.a_bytes = pa.array([a_bytes.get(i, b"") for i in range(max(a_bytes) + 1)], pa.large_binary())
        self.b_bytes = pa.array(b_bytes, pa.large_binary())
        self.a_len, self.b_len = (np.array([len(x) for x in t.to_pylist()], np.int64) for t in (self.a_bytes, self.b_bytes))
        #: ids as text after each of the three separators
        self.written, self.ids = pa.array([f"{s}{i}" for s in ";,|" for i in range(n)], pa.large_string()), n

    def chunks(self, text: str) -> list[str]:
        return [text] if self.whole else CUT.split(text)

    def encode(self, chunks: list[str]) -> tuple[list, list]:
        """Ids of " " + chunk by A, and of the chunk by B, which adds the space."""
        left, slow = [None] * len(chunks), []
        for i, c in enumerate(chunks):
            if self.fast and COMMON.fullmatch(c):
                left[i] = self.fast.encode_ordinary(" " + c)
            else:
                slow.append(i)
        for i, e in zip(slow, self.a.encode_batch([" " + chunks[i] for i in slow], add_special_tokens=False) if slow else [], strict=True):
            left[i] = e.ids
        return left, self.b.encode(chunks, num_threads=1) if chunks else []


def tokenizers(*paths: str) -> Tokenizers:
    kept = worker_cache("alignment")
    if paths not in kept:
        kept[paths] = Tokenizers(*paths)
    return kept[paths]


def union_find(a, b, n_a: int, n_b: int):
    """Component of each A and each B token of links (a, b): the smallest A token in it, by hooking roots and jumping."""
    import numpy as np

    up = np.arange(n_a + n_b)
    b = b + n_a
    while len(a):
        x, y = up[a], up[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while True:
            above = up[up]
            if (above == up).all():
                break
            up = above
    return up[:n_a], up[n_a:]


def overlaps(a_len, b_len):
    """Links of two tokenisations of the same bytes, by their tokens' lengths (none of them 0): one for each overlap."""
    import numpy as np

    a_start, b_start = np.cumsum(a_len) - a_len, np.cumsum(b_len) - b_len
    starts = np.union1d(a_start, b_start)  # an overlap of two ranges begins where one of them does
    return np.searchsorted(a_start, starts, "right") - 1, np.searchsorted(b_start, starts, "right") - 1


def coded(both: Tokenizers, chunks: list[str]) -> dict:
    """All that is told of distinct chunks: counts of tokens, groups and links, pairs of ids by link, groups as text."""
    import numpy as np
    import pyarrow as pa

    lists = both.encode(chunks)
    want = [(" " + c).encode() for c in chunks]
    counts = [np.array([len(x) for x in side], np.int64) for side in lists]
    ids = [np.fromiter((i for x in side for i in x), np.int64, int(c.sum())) for side, c in zip(lists, counts, strict=True)]
    size, good = np.array([len(w) for w in want], np.int64), np.ones(len(chunks), bool)
    for side, known, length in ((0, both.a_bytes, both.a_len), (1, both.b_bytes, both.b_len)):
        total = np.concatenate([[0], np.cumsum(length[ids[side]])])
        ends = np.cumsum(counts[side])
        same = total[ends] - total[ends - counts[side]] == size
        data = known.take(pa.array(ids[side])).buffers()[2]
        if not (same.all() and (data.to_pybytes() if data else b"") == b"".join(want)):
            of = known.to_pylist()
            same = np.array([b"".join(of[i] for i in x) == w for x, w in zip(lists[side], want, strict=True)], bool)
        good &= same
    for side in (0, 1):
        ids[side] = ids[side][np.repeat(good, counts[side])]
        counts[side] = np.where(good, counts[side], 0)
    n_a, n_b = len(ids[0]), len(ids[1])
    a, b = overlaps(both.a_len[ids[0]], both.b_len[ids[1]])
    a_root, b_root = union_find(a, b, n_a, n_b)
    first = a_root == np.arange(n_a)
    a_group = np.cumsum(first)[a_root] - 1  # components in the order of their first tokens
    b_group = np.cumsum(first)[b_root] - 1
    chunk = [np.repeat(np.arange(len(chunks)), c) for c in counts]
    n_groups = np.bincount(chunk[0][first], minlength=len(chunks))
    n_links = np.bincount(chunk[0][a], minlength=len(chunks))
    # the members of each group, those of A before those of B, each after its separator
    groups = int(first.sum())
    a_upto, b_upto = (np.cumsum(np.bincount(g, minlength=groups)) for g in (a_group, b_group))
    a_at = np.arange(n_a) + np.concatenate([[0], b_upto])[a_group]
    b_at = np.arange(n_b) + a_upto[b_group] if groups else np.zeros(0, np.int64)
    b_first = np.diff(b_group, prepend=-1) > 0
    stream = np.zeros(n_a + n_b, np.int64)
    stream[a_at], stream[b_at] = ids[0] + np.where(first, 0, both.ids), ids[1] + np.where(b_first, 2, 1) * both.ids
    text = both.written.take(pa.array(stream))
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    ends = np.concatenate([[0], np.cumsum(counts[0] + counts[1])])
    text = pa.LargeStringArray.from_buffers(len(chunks), pa.py_buffer(offsets[ends].tobytes()), text.buffers()[2])
    return {"good": good, "n_a": counts[0], "n_b": counts[1], "n_groups": n_groups, "n_links": n_links, "pairs": (ids[0][a] << SHIFT) | ids[1][b], "text": text}


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _block(both: Tokenizers, texts: list):
    """Counts, digests and pairs of a block's documents: (counts by name, digests, distinct pairs, documents of each, packed pairs by document)."""
    import numpy as np
    import pyarrow as pa

    place: dict[str, int] = {}
    codes, n_chunks = [], []
    for t in texts:
        parts = both.chunks(t) if t else []
        codes += [place.setdefault(p, len(place)) for p in parts]
        n_chunks.append(len(parts))
    codes, n_chunks = np.array(codes, np.int64), np.array(n_chunks, np.int64)
    known = coded(both, list(place))
    doc = np.repeat(np.arange(len(texts)), n_chunks)
    bad = np.zeros(len(texts), bool)
    bad[doc[~known["good"][codes]]] = True
    kept = ~bad[doc]
    codes, doc = codes[kept], doc[kept]
    counts = {k: np.bincount(doc, weights=known[k][codes], minlength=len(texts)).astype(np.int64) for k in COUNTS}
    digests, ends = [], np.cumsum(np.bincount(doc, minlength=len(texts)))
    text = known["text"].take(pa.array(codes))
    data = memoryview(text.buffers()[2] or b"")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    for start, end in zip(offsets[np.concatenate([[0], ends[:-1]])], offsets[ends], strict=True):
        digests.append(hashlib.sha256(data[start + 1 : end]).hexdigest() if end > start else "")
    pairs, local = np.unique(known["pairs"], return_inverse=True)
    links_at = np.cumsum(known["n_links"]) - known["n_links"]
    n = known["n_links"][codes]
    each = (np.repeat(doc, n) << 32) | local[spans(links_at[codes], n)]
    each, times = np.unique(each, return_counts=True)
    of, pair = each >> 32, each & 0xFFFFFFFF
    per = np.bincount(of, minlength=len(texts))
    step = np.diff(pair, prepend=0)
    heads = (np.cumsum(per) - per)[per > 0]
    step[heads] = pair[heads]  # differences within each document are small numbers
    return counts, digests, pairs, np.bincount(pair, minlength=len(pairs)), pack(per, step, times)


def align(docs: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per document, over whole texts.

    n_best counts the links whose pair has the most documents of all pairs of its A id, ties included; count_sum sums
    the pairs' documents over the links. Null and empty texts, and those that a tokenizer doesn't give back byte by
    byte, have no tokens: zeros and ''. Repeated rows and null ids are documents of their own; an empty table gives
    an empty result. Only doc_id and text are read. A document longer than a block is a block of its own, in the
    memory of one task (about 60 bytes a byte of text).
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"block bigint, ids array<{kind}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, digests array<string>, pairs array<bigint>, docs array<bigint>, packed binary"

    def write(batches):
        import pyarrow as pa

        both, number = tokenizers(a_path, b_path, pattern), block_ids()
        for batch in text_batches(batches, BLOCK):
            counts, digests, pairs, held, packed = _block(both, batch.column(1).to_pylist())
            values = [[next(number)], [batch.column(0).to_pylist()], *([counts[k]] for k in COUNTS), [digests], [pairs], [held], [packed]]
            types = [pa.int64(), pa.list_(batch.column(0).type), *[pa.list_(pa.int64())] * 4, pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names)

    names = ["block", "ids", *COUNTS, "digests", "pairs", "docs", "packed"]
    blocks = cut(docs.select("doc_id", F.col("text").cast("string")).mapInArrow(write, schema), "align-blocks")
    listed = blocks.select(F.inline(F.arrays_zip("pairs", "docs"))).groupBy(F.col("pairs").alias("key")).agg(F.sum("docs").alias("n"))
    counted = cut(listed, "align-pairs")
    most = counted.groupBy(F.shiftright("key", SHIFT).alias("a")).agg(F.max("n").alias("most"))
    counted = counted.join(most, F.shiftright("key", SHIFT) == F.col("a")).select("key", "n", (F.col("n") == F.col("most")).alias("best"))
    joined = look_up(blocks.drop("docs"), "pairs", counted, F.col("n") * 2 + F.col("best").cast("int"))

    def told(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                at = {c: batch.column(c).slice(row, 1) for c in ("ids", *COUNTS, "digests", "found")}
                at = {c: x.flatten() for c, x in at.items()}
                per, step, times = unpack(batch.column("packed")[row].as_py())
                of = np.repeat(np.arange(len(per)), per)
                heads, pair = np.cumsum(per) - per, np.cumsum(step)
                base = np.zeros(len(per), np.int64)
                some = per > 0
                base[some] = pair[heads[some]] - step[heads[some]]
                value = np.asarray(at["found"])[pair - base[of]] if len(pair) else np.zeros(0, np.int64)
                sums = [np.zeros(len(per), np.int64) for _ in range(2)]
                for total, x in zip(sums, (times * (value & 1), times * (value >> 1)), strict=True):
                    np.add.at(total, of, x)
                out = [at["ids"], *(at[c] for c in COUNTS), *map(pa.array, sums), at["digests"]]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"])

    return joined.mapInArrow(told, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as known

    return align(table(spark, sf_dir, "documents"), known.path("byte_bpe_50k.json"), known.path("piece_bpe_32k.model"), known.PATTERN)


QUERIES = {"op12_alignment": op12_alignment}
ORACLE: dict[str, str] = {}
