"""Byte-level BPE: encoding by tree reduction, and decoding.

Encoding is a monoid: a text is cut into halves, each is encoded by itself, and two neighbours are joined by
encoding again a window around their boundary that grows until the tokens at its two ends are the ones that
were there before. A token sequence is the encoding of its bytes exactly when each pair of neighbouring tokens
is the encoding of their concatenation; so once the window's outer tokens are unchanged, every pair outside
it, inside it and across its ends is valid, and all tokens outside are final. The same holds one level up for
the pre-token boundaries of the text: a match depends on nothing to its left, so the right half's matches are
final from the first boundary that both tokenisations share. Decoding is a monoid without a boundary: the
halves of the ids are decoded by themselves and their bytes concatenated, up the same kind of tree.
"""

from __future__ import annotations

import hashlib
import heapq
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_batches, worker_cache

LEAF = 8  # bytes that are merged directly
SPAN = 1 << 10  # characters of text that are split into pre-tokens directly
IDS = 1 << 8  # ids that are decoded directly
CACHE = 600_000  # distinct chunks that a worker remembers
SHARED = 100_000  # leaves, and meetings of two tokens, that it remembers: both come again in many pre-tokens

#: White space-delimited chunks: every pre-token lies within one, and their own boundaries are pre-token boundaries.
CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Characters on which Python's \s and Unicode's White_Space differ; texts that hold one are split by the pattern itself.
ODD = re.compile("[\x1c-\x1f]")


def load_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.bytes_of = ranks, {rank: token for token, rank in ranks.items()}
        self.bytes_of_text = {str(rank): token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.chunks: dict[str, str] = {}
        self.pieces: dict[str, str] = {}
        self.leaves: dict[bytes, list[int]] = {}
        self.seams: dict[tuple[int, int], list[int]] = {}

    def leaf(self, raw: bytes) -> list[int]:
        """The merges in order of rank, leftmost first, by a heap over a linked list."""
        ranks, n, none = self.ranks, len(raw), 1 << 60
        if (whole := ranks.get(raw)) is not None:
            return [whole]
        if n <= 24:  # short: scan for the least rank each time; parts are told by where they begin
            get, at = ranks.get, list(range(n + 1))
            found = [get(raw[i : i + 2], none) for i in range(n - 1)]
            while found and (least := min(found)) < none:
                i = found.index(least)
                del at[i + 1], found[i]
                if i < len(found):
                    found[i] = get(raw[at[i] : at[i + 2]], none)
                if i:
                    found[i - 1] = get(raw[at[i - 1] : at[i + 1]], none)
            return [ranks[raw[x:y]] for x, y in zip(at, at[1:], strict=False)]
        parts: list[bytes] = [raw[i : i + 1] for i in range(n)]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        gone = [False] * len(parts)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= len(parts) or parts[i] != a or parts[j] != b:
                continue
            parts[i], gone[j], after[i] = a + b, True, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < len(parts) and (r := ranks.get(parts[left] + parts[after[left]])) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[after[left]]))
        return [ranks[p] for p, dead in zip(parts, gone, strict=True) if not dead]

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of the concatenated bytes of two encodings."""
        if not a or not b:
            return a or b
        seam = a[-1], b[0]
        window = self.seams.get(seam)
        if window is None:  # the same two tokens meet again and again
            if len(self.seams) > SHARED:
                self.seams.clear()
            window = self.leaf(self.bytes_of[a[-1]] + self.bytes_of[b[0]])
            window = self.seams[seam] = () if window == [*seam] else window
        if not window:  # they stay as they are
            return a + b
        i = j = 1
        while True:
            left, right = i == len(a) or window[0] == a[-i], j == len(b) or window[-1] == b[j - 1]
            if left and right:
                return a[:-i] + window + b[j:]
            i, j = i if left else min(len(a), 2 * i), j if right else min(len(b), 2 * j)
            window = self.leaf(b"".join([self.bytes_of[t] for t in a[-i:] + b[:j]]))

    def piece(self, raw: bytes) -> list[int]:
        """One pre-token: halves recursively, joined up the tree."""
        if len(raw) <= LEAF:
            ids = self.leaves.get(raw)
            if ids is None:
                if len(self.leaves) > SHARED:
                    self.leaves.clear()
                ids = self.leaves[raw] = self.leaf(raw)
            return ids
        half = len(raw) // 2
        return self.join(self.piece(raw[:half]), self.piece(raw[half:]))

    def chunk(self, text: str) -> str:
        """The ids of a chunk's pre-tokens, each after a comma. A chunk that is one pre-token is left to encode() to keep."""
        parts, out = self.pattern.findall(text), []
        for p in parts:
            ids = self.pieces.get(p) or self.chunks.get(p)  # a pre-token may have been a chunk of its own
            if ids is None:
                ids = "".join([f",{i}" for i in self.piece(p.encode())])
                if len(parts) > 1 and len(p) <= 64:
                    if len(self.pieces) > CACHE // 3:
                        self.pieces.clear()
                    self.pieces[p] = ids
            out.append(ids)
        return "".join(out)

    def split(self, text: str) -> list[str]:
        """The text's chunks; of a long text by halves, joined at a boundary that both sides share."""
        if ODD.search(text):
            return self.pattern.findall(text)
        if len(text) <= SPAN:
            return CHUNK.findall(text)
        half = len(text) // 2
        left, right = self.split(text[:half]), self.split(text[half:])
        last, ahead, k = left.pop(), "", 0
        while k < len(right):  # what follows the cut is final from the first shared boundary on
            ahead += right[k]
            k += 1
            parts, at = CHUNK.findall(last + ahead + (right[k] if k < len(right) else "")), 0
            for n, part in enumerate(parts):
                at += len(part)
                if at == len(last) + len(ahead):
                    return left + parts[: n + 1] + right[k:]
                if at > len(last) + len(ahead):
                    break
        return left + CHUNK.findall(last + ahead)

    def encode(self, text: str) -> str:
        """All ids, each after a comma."""
        known, out = self.chunks, []
        for c in self.split(text):
            ids = known.get(c)
            if ids is None:
                ids = self.chunk(c)
                if len(c) <= 64:
                    if len(known) > CACHE:
                        known.clear()
                    known[c] = ids
            out.append(ids)
        return "".join(out)

    def decode(self, ids: list) -> bytes:
        """The bytes of the ids (numbers, or all as decimal text): halves recursively, concatenated up the tree."""
        of = self.bytes_of_text if ids and isinstance(ids[0], str) else self.bytes_of

        def part(a: int, b: int) -> bytes:
            if b - a <= IDS:
                return b"".join(map(of.__getitem__, ids[a:b]))
            half = (a + b) // 2
            return part(a, half) + part(half, b)

        return part(0, len(ids))


def codec(path: str, pattern: str) -> Codec:
    """The worker process's codec for a rank file, with what it remembers of chunks."""
    kept = worker_cache("bpe")
    if (path, pattern) not in kept:
        kept[path, pattern] = Codec(load_ranks(path), pattern)
    return kept[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, with `ids` also the ids (array<int>), one row per document.

    The whole text is encoded by the rank file at `path` (present on every worker), each match of `pattern`
    separately and without special tokens; then the ids are decoded. Null texts are empty: no ids, the digests
    of nothing. Rows are independent, so repeated rows and null ids pass through, and an empty table gives an
    empty result. Only doc_id and text are read; a very long text
    is one string of its task, coded by halves.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        own = codec(path, pattern)
        for batch in text_batches(batches):
            rows: list[list] = [[], [], [], []]
            for text in batch.column(1).to_pylist():
                coded = own.encode(text or "")[1:]
                numbers = coded.split(",") if coded else []
                rows[0].append(len(numbers))
                rows[1].append(hashlib.sha256(coded.encode()).hexdigest())
                rows[2].append(hashlib.sha256(own.decode(numbers)).hexdigest())
                if ids:
                    rows[3].append(np.array(numbers, dtype=np.int32) if numbers else np.zeros(0, np.int32))
            out = [batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                out, names = [*out, pa.array(rows[3], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


QUERIES = {"op10_bpe": op10_bpe}
ORACLE: dict[str, str] = {}
