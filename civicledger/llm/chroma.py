"""Chroma audio fingerprints of media columns, and alignment of recordings.

Audio (mono PCM WAV) becomes frames of 12 pitch classes by windowed FFTs. Over the integral image of
(time x pitch class), sixteen rectangle filters each give the log ratio of two areas, quantised to two Gray
coded bits: one packed 32-bit integer for each frame position. Recordings that share pairs of neighbouring
integers vote for time offsets; the histogram's top offset is checked by the share of differing bits over the
whole overlap.

Equal fingerprints are searched once. Every other recording votes with all earlier holders of its integers, and
every pair of recordings and offset with enough votes is checked; what passes makes classes. How many pairs pass
grows with the square of the table, as few tones make few integers, and so does the counting: it is done in blocks
of bounded size, each two of which meet once, and only best matches and links that connect leave a block.
"""

from __future__ import annotations

import io
import wave
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, table
from .components import components

FFT, HOP, LOWEST = 512, 128, 110.0
WIDTH = 16  # frames that the widest filter spans
#: (kind, first pitch class, classes high, frames wide): six rectangle patterns, sizes and places by a rule
FILTERS = [(i % 6, (5 * i) % 12 // 2, 2 + (3 * i) % 5, 4 + (7 * i) % 13) for i in range(16)]
STEP = 0.25  # quantiser's step in log ratio
GRAY = (0, 1, 3, 2)


def samples(audio: bytes | None):
    """(rate, floats) of a mono 8 or 16 bit WAV; nothing of what isn't one."""
    import numpy as np

    try:
        with wave.open(io.BytesIO(audio or b"")) as w:
            raw, width, rate, channels = w.readframes(w.getnframes()), w.getsampwidth(), w.getframerate(), w.getnchannels()
    except (wave.Error, EOFError):
        return 0, np.zeros(0, np.float32)
    x = np.frombuffer(raw, np.uint8).astype(np.float32) - 128 if width == 1 else np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(np.float32) / 256
    return rate, x[: len(x) // channels * channels].reshape(-1, channels).mean(1)


def chroma(rate: int, x):
    """Frames x 12: power by pitch class, each frame of unit length (silence: zeros)."""
    import numpy as np

    if len(x) < FFT:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(x, FFT)[::HOP] * np.hanning(FFT).astype(np.float32)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    freq = np.arange(power.shape[1]) * rate / FFT
    use = np.flatnonzero((freq >= LOWEST) & (freq <= rate / 2.2))
    pitch = np.round(12 * np.log2(freq[use] / LOWEST)).astype(int) % 12
    fold = np.zeros((power.shape[1], 12))
    fold[use, pitch] = 1
    c = power @ fold
    return (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def fingerprint(c):
    """Packed 32-bit integers, one for each position of the widest filter."""
    import numpy as np

    n = len(c) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(0).cumsum(1)
    t = np.arange(n)

    def area(t0, t1, p0, p1):
        return image[t + t1, p1] - image[t + t0, p1] - image[t + t1, p0] + image[t + t0, p0]

    out = np.zeros(n, np.uint32)
    for kind, p, h, w in FILTERS:
        q, hh, hw = min(12, p + h), max(1, h // 2), max(1, w // 2)
        whole = area(0, w, p, q)
        if kind == 0:
            a = whole
            b = area(0, w, 0, 12) / 12 * (q - p)
        elif kind == 1:
            a, b = area(0, w, p, p + hh), area(0, w, p + hh, q)
        elif kind == 2:
            a, b = area(0, hw, p, q), area(hw, w, p, q)
        elif kind == 3:
            a = area(0, hw, p, p + hh) + area(hw, w, p + hh, q)
            b = whole - a
        elif kind == 4:
            a = area(0, w, p + h // 3, p + h // 3 + max(1, h // 3))
            b = whole - a
        else:
            a = area(w // 3, w // 3 + max(1, w // 3), p, q)
            b = whole - a
        level = np.clip(np.floor(np.log((1 + a) / (1 + b)) / STEP) + 2, 0, 3).astype(int)
        out = (out << np.uint32(2)) | np.array(GRAY, np.uint32)[level]
    return out.astype(np.int32)


def fingerprints(recordings: DataFrame) -> DataFrame:
    """(rec_id, n_frames, fp array<int>) of (rec_id, audio); a null, broken or short recording has an empty one."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            got = [chroma(*samples(a)) for a in pdf["audio"]]
            yield pd.DataFrame({"rec_id": pdf["rec_id"], "n_frames": [len(c) for c in got], "fp": [fingerprint(c).tolist() for c in got]})

    return recordings.select("rec_id", "audio").mapInPandas(run, "rec_id bigint, n_frames bigint, fp array<int>")


#: Integers of the recordings in one block, about; blocks at least, so that small tables spread too; places at which keys meet, or
#: integers that are compared, at a time.
SHARE, BLOCKS, AT_ONCE = 2_000_000, 8, 1_000_000


def align(prints: DataFrame, votes: int = 3, most_error: float = 0.35, share: int = SHARE) -> DataFrame:
    """rec_id, n_frames, copy_of, match_id, frame_offset, votes, bit_error, class_id: one row for each recording.

    copy_of is the least rec_id with an equal fingerprint. Each pair of neighbouring integers votes for every
    earlier recording that has it, at the offset between their places; of the recordings and offsets with `votes`
    at least whose bits over the whole overlap differ by `most_error` at most, a recording's match is the one with
    most votes (ties to the smaller id, then the smaller offset). class_id is the least rec_id that copies and all
    pairs that pass lead to, whether or not they are a match. A positive offset means that the match's frames come
    later in this recording. Empty fingerprints are copies of each other and match nothing, fingerprints of one
    integer are copies of their equals and match nothing else; null ids take no part; repeated rows count as one, and
    of different recordings of one rec_id that of the least digest counts. A recording is a row's array of integers,
    8 for each second or fewer, whatever its length; a pair of integers that comes again in it keeps its first place.
    """
    digest = F.sha2(F.array_join("fp", ",").cast("binary"), 256)
    own = prints.where("rec_id is not null").groupBy("rec_id").agg(F.min_by(F.struct("n_frames", "fp"), F.struct(digest, "n_frames")).alias("r"))
    rows = cut(own.select("rec_id", "r.*"), "chroma-prints")
    copies = cut(rows.groupBy(digest.alias("d")).agg(F.min("rec_id").alias("copy_of")), "chroma-copies")
    known = cut(rows.select("rec_id", "n_frames", digest.alias("d")).join(copies, "d").drop("d"), "chroma-known")
    reps = cut(rows.join(copies.select(F.col("copy_of").alias("rec_id")), "rec_id", "left_semi").where(F.size("fp") > 1), "chroma-reps")
    drop(rows, copies)
    good = cut(matches(reps, votes, most_error, share), "chroma-matches")
    drop(reps)
    order = F.struct((-F.col("votes")).alias("v"), "match_id", "frame_offset")
    best = good.where("NOT link").groupBy(F.col("rec_id").alias("copy_of")).agg(F.min_by(F.struct("match_id", "frame_offset", "votes", "bit_error"), order).alias("b")).select("copy_of", "b.*")
    classes = components(good.where("link").select(F.col("rec_id").alias("a"), F.col("match_id").alias("b"))).withColumnRenamed("node", "copy_of")
    least = classes.groupBy("comp").agg(F.min("copy_of").alias("class_id"))
    classes = classes.join(least, "comp").drop("comp")
    out = known.join(best, "copy_of", "left").join(classes, "copy_of", "left").withColumn("class_id", F.coalesce("class_id", "copy_of"))
    return out.select("rec_id", "n_frames", "copy_of", "match_id", "frame_offset", "votes", "bit_error", "class_id")


def matches(reps: DataFrame, votes: int, most_error: float, share: int = SHARE) -> DataFrame:
    """(rec_id, match_id, frame_offset, votes, bit_error, link) of different fingerprints (rec_id, fp).

    Recordings are dealt into blocks by their ids' hashes, and every two blocks meet in a group of their own. All pairs are
    counted and checked there; what leaves it is each recording's best match within the group, and links (`link`) that
    connect what all of the group's passing pairs connect: two rows for each recording at most.
    """
    n = reps.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("fp")), F.lit(0)).alias("size")).first()
    blocks = min(max(BLOCKS, -(-n["size"] // share)), max(1, n["n"]))
    own = reps.select("rec_id", "fp", F.pmod(F.xxhash64("rec_id"), F.lit(blocks)).alias("block"))
    sent = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_with"))
    sent = sent.withColumn("meeting", F.least("block", "_with") * blocks + F.greatest("block", "_with")).drop("_with")

    def run(key, group):
        import numpy as np
        import pyarrow as pa

        low, high = divmod(key[0].as_py(), blocks)
        fp, block = group.column("fp").combine_chunks(), group.column("block").to_numpy()
        ids, sizes = group.column("rec_id").to_numpy(), np.diff(fp.offsets.to_numpy())
        best, links = block_matches(ids, sizes, fp.flatten().to_numpy(), block == low, block == high, votes, most_error)
        x, y, shift, n, error = (np.concatenate(c) for c in zip(best, links, strict=True))
        link = np.arange(len(x)) >= len(best[0])
        return pa.table({"rec_id": ids[x], "match_id": ids[y], "frame_offset": shift.astype(np.int32), "votes": n, "bit_error": error, "link": link})

    return sent.groupBy("meeting").applyInArrow(run, "rec_id bigint, match_id bigint, frame_offset int, votes bigint, bit_error double, link boolean")


def marks(sizes, flat):
    """(key, recording, place) by recording: the pairs of neighbouring integers. A held tone repeats a pair: its first place stands for it."""
    import numpy as np

    rec = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[rec]
    inner = np.flatnonzero(at < sizes[rec] - 1)
    key, rec, at = flat[inner].astype(np.int64) << 32 ^ flat[inner + 1].astype(np.int64) & 0xFFFFFFFF, rec[inner], at[inner]
    order = np.lexsort((key, rec))  # stable, so places of a key stay in order
    key, rec, at = key[order], rec[order], at[order]
    first = np.append(True, (key[1:] != key[:-1]) | (rec[1:] != rec[:-1]))[: len(key)]
    return key[first], rec[first], at[first]


def block_matches(ids, sizes, flat, left, right, votes: int, most_error: float):
    """Best matches and links of the pairs of a recording in `left` with one in `right` (masks: the same or disjoint ones), each as
    arrays: recording and match as places in `ids`, offset, votes, share of differing bits.

    Keys meet AT_ONCE at a time, or those of one recording: at most one for each mark on the other side.
    """
    import numpy as np

    key, rec, at = marks(sizes, flat)
    mine, theirs = np.flatnonzero(left[rec]), np.flatnonzero(right[rec])
    a_key, a_rec, a_at = key[mine], rec[mine], at[mine]
    theirs = theirs[np.argsort(key[theirs], kind="stable")]
    b_key, b_rec, b_at = key[theirs], rec[theirs], at[theirs]
    low = np.searchsorted(b_key, a_key, "left")
    n = np.searchsorted(b_key, a_key, "right") - low
    before = np.cumsum(np.bincount(a_rec, n, len(ids)).astype(np.int64))
    lot = (before // AT_ONCE)[a_rec]
    ends = np.flatnonzero(np.append(lot[1:] != lot[:-1], True)) + 1 if len(lot) else []
    start, starts, best, links, root = 0, np.cumsum(sizes) - sizes, None, [], np.arange(len(ids))
    for end in ends:
        m = n[start:end]
        i = np.repeat(np.arange(start, end), m)
        j = low[i] + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
        start = end
        x, y, shift = a_rec[i], b_rec[j], a_at[i] - b_at[j]
        swap = ids[x] < ids[y]
        if (left == right).all():  # a block with itself has each pair twice
            x, y, shift = x[~swap], y[~swap], shift[~swap]
            x, y, shift = (c[x != y] for c in (x, y, shift))
        else:
            x, y, shift = np.where(swap, y, x), np.where(swap, x, y), np.where(swap, -shift, shift)
        order = np.lexsort((shift, y, x))
        x, y, shift = x[order], y[order], shift[order]
        new = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (shift[1:] != shift[:-1]))[: len(x)])
        count = np.diff(np.append(new, len(x)))
        new, count = new[count >= votes], count[count >= votes]
        x, y, shift = x[new], y[new], shift[new]
        error = bit_errors(flat, starts, sizes, x, y, shift)
        found = tuple(c[error <= most_error] for c in (x, y, shift, count, error))
        merged = found if best is None else tuple(np.concatenate(c) for c in zip(best, found, strict=True))
        order = np.lexsort((merged[2], ids[merged[1]], -merged[3], merged[0]))
        order = order[np.append(True, np.diff(merged[0][order]) != 0)[: len(order)]]
        best = tuple(c[order] for c in merged)
        used = tree(root, found[0], found[1])
        links.append(tuple(c[used] for c in found))
    nothing = tuple(np.zeros(0, t) for t in (int, int, int, int, float))
    return best or nothing, tuple(np.concatenate(c) for c in zip(nothing, *links, strict=True))


def bit_errors(flat, starts, sizes, x, y, shift):
    """Shares of differing bits of fingerprints x and y where they overlap, y moved by `shift`."""
    import numpy as np

    from_x, from_y = np.maximum(shift, 0), np.maximum(-shift, 0)
    n = np.minimum(sizes[x] - from_x, sizes[y] - from_y)
    lot, out, start = np.cumsum(n) // AT_ONCE, np.zeros(len(x)), 0
    for end in np.flatnonzero(np.append(lot[1:] != lot[:-1], True)[: len(lot)]) + 1:
        m = n[start:end]
        first = np.cumsum(m) - m
        inside = np.arange(m.sum()) - np.repeat(first, m)
        a = flat[np.repeat((starts[x] + from_x)[start:end], m) + inside]
        b = flat[np.repeat((starts[y] + from_y)[start:end], m) + inside]
        differ = np.bitwise_count((a ^ b).view(np.uint32)).astype(np.int64)
        out[start:end] = np.add.reduceat(differ, first) / (m * 32)
        start = end
    return out


def tree(root, x, y):
    """Places of the edges (x, y) that join two components; `root` (each node's root) is kept up to date."""
    import numpy as np

    up, used = {}, []

    def top(node):
        while node in up:
            node = up[node]
        return node

    for e in np.flatnonzero(root[x] != root[y]).tolist():
        a, b = top(root[x[e]]), top(root[y[e]])
        if a != b:
            up[max(a, b)] = min(a, b)
            used.append(e)
    if up:
        to = np.arange(len(root))
        to[list(up)] = list(up.values())
        while (to != to[to]).any():
            to = to[to]
        root[:] = to[root]
    return np.array(used, int)


def altered(pcm: bytes) -> bytes:
    """A recording with silence before it, with noise, or cut out of its middle, as its own checksum decides."""
    import numpy as np

    n = zlib.crc32(pcm)
    if n % 3 == 0:
        return bytes([128]) * (10 * HOP) + pcm
    if n % 3 == 1:
        x = np.frombuffer(pcm, np.uint8).astype(int) + np.random.default_rng(n).integers(-8, 9, len(pcm))
        return np.clip(x, 0, 255).astype(np.uint8).tobytes()
    start = len(pcm) // 4 // HOP * HOP
    return pcm[start : len(pcm) - start]


def sonify(vectors: DataFrame, rate: int = 2000, note: int = 256, altered_every: int = 40) -> DataFrame:
    """(rec_id, audio): a WAV for each vector, a tone for each component, its pitch the component's place between
    the vector's least and largest. The tables hold no recordings; these stand for them, copies included. Every
    `altered_every`-th id comes a second time, altered, as recording -1 - id."""

    def wav(pcm):
        f = io.BytesIO()
        with wave.open(f, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(rate)
            w.writeframes(pcm)
        return f.getvalue()

    def run(batches):
        import numpy as np
        import pandas as pd

        t = np.arange(note) / rate
        tones = np.array([np.sin(2 * np.pi * LOWEST * 2 ** (1 + k / 12) * t) for k in range(12)])
        for pdf in batches:
            ids, out = [], []
            for i, v in zip(pdf["vec_id"], pdf["embedding"], strict=True):
                x = np.array([np.nan if c is None else c for c in v] if v is not None else [], float)
                x = x[np.isfinite(x)]
                span = (x.max() - x.min()) if len(x) else 0
                keys = np.minimum(11, (x - x.min()) / span * 12).astype(int) if span else np.zeros(len(x), int)
                pcm = (tones[keys].ravel() * 100 + 128).astype(np.uint8).tobytes()
                ids, out = [*ids, i], [*out, wav(pcm)]
                if i == i and i is not None and i % altered_every == 0 and pcm:
                    ids, out = [*ids, -1 - i], [*out, wav(altered(pcm))]
            yield pd.DataFrame({"rec_id": pd.array(ids, "Int64"), "audio": out})

    spread = vectors.sparkSession.sparkContext.defaultParallelism * 4
    return vectors.select("vec_id", "embedding").repartition(spread).mapInPandas(run, "rec_id bigint, audio binary")


def op7_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(fingerprints(sonify(table(spark, sf_dir, "embeddings"))))


QUERIES = {"op7_chroma_fingerprints": op7_chroma_fingerprints}
ORACLE: dict[str, str] = {}
