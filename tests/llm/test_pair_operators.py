"""Archives, deduplication, joins, fingerprints and search against brute force."""

import collections
import hashlib
import io
import random
import re
import zipfile

import numpy as np
import pytest

from civicledger.llm import ann, chroma, jaccard, lines, substrings, warc
from civicledger.llm.common import shared_path
from civicledger.llm.components import components
from civicledger.llm.registry import oracle_sql, queries

from ..conftest import SMALL, same_rows


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(500, 560)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[find(a)] = find(b)
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == set(parent)
    groups = collections.defaultdict(set)
    for x in parent:
        groups[find(x)].add(got[x])
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


# -- WARC


@pytest.mark.parametrize("name", ["op2_warc", "op4_line_dedup"])
def test_oracles(spark, name):
    assert same_rows(spark, queries()[name], oracle_sql()[name])


def test_warc_round_trip(spark):
    rows = [(1, "http://a/ b\r\n", "<p>é</p>", 1), (2, None, "<p>é</p>", 2), (3, "u", None, 3), (4, "u", "", 4), (4, "u", "", 4), (None, "u", "x" * 100_000, 5), (6, "http://ü", "y", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, d int")
    folder = shared_path(spark, "t-warc")
    out = warc.read_archives(warc.write_archives(pages, folder), folder, payloads=True).collect()
    got = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"]), r["payload_bytes"]) for r in out)
    assert got == sorted([("1", "revisit", "2", 9), ("2", "response", "None", 9), ("3", "revisit", "4", 0), ("4", "response", "None", 0), ("4", "response", "None", 0), ("None", "response", "None", 100_000), ("6", "response", "None", 1)])
    assert {bytes(r["payload"]) for r in out if r["record_type"] == "response"} == {"<p>é</p>".encode(), b"", b"x" * 100_000, b"y"}
    large = warc.plan_records(pages, least_bytes=5).where("_revisit").collect()
    assert [r["page_id"] for r in large] == [1]
    none = shared_path(spark, "t-warc")
    assert warc.read_archives(warc.write_archives(pages.limit(0), none), none).count() == 0


class Blob:
    def __init__(self, raw):
        self.raw = raw

    def read_at(self, n, at):
        return self.raw[at : at + n]


@pytest.mark.parametrize("wide", [False, True])
def test_central_directory(wide):
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        for name, body in (("a.txt", b"hello"), ("d/b.bin", b"\0" * 70_000)):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=wide) as m:
                m.write(body)
        z.comment = b"PK\5\6 in a comment"[4:]
    raw = f.getvalue()
    members = warc.central_directory(Blob(raw), len(raw))
    at = warc.stored_start(Blob(raw), members["a.txt"])
    assert raw[at : at + members["a.txt"][2]] == b"hello" and members["d/b.bin"][2] == 70_000


def test_zip64_end_record():
    import struct

    name, body = b"x", b"payload"
    local = struct.pack("<4s5H3I2H", b"PK\3\4", 45, 0, 0, 0, 0, 0, 7, 7, 1, 0) + name + body
    extra = struct.pack("<HHQQQ", 1, 24, 7, 7, 0)
    entry = struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    end64 = struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, len(entry), len(local))
    raw = local + entry + end64 + struct.pack("<4sIQI", b"PK\6\7", 0, len(local) + len(entry), 1) + struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    members = warc.central_directory(Blob(raw), len(raw))
    at = warc.stored_start(Blob(raw), members["x"])
    assert raw[at : at + members["x"][2]] == body


# -- repeated substrings


def brute_substrings(docs, least=200):
    raw = [(t or "").encode() for _, t in docs]
    seen = collections.Counter(r[p : p + least] for r in raw for p in range(len(r) - least + 1))
    out = []
    for (i, _), r in zip(docs, raw, strict=True):
        gone = [False] * len(r)
        for p in range(len(r) - least + 1):
            if seen[r[p : p + least]] > 1:
                gone[p : p + least] = [True] * least
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((i, len(r), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_cover_is_a_perfect_difference_set():
    gaps = [(a - b) % substrings.MODULUS for a in substrings.COVER for b in substrings.COVER if a != b]
    assert sorted(gaps) == list(range(1, substrings.MODULUS))


def test_substrings(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(substrings, "RANGE_KEYS", 500)
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(900)) for _ in range(8)]
    docs = []
    for i in range(220):
        x = ""
        for _ in range(rng.randint(0, 4)):
            b, k, a = rng.choice(base), rng.random(), rng.randint(0, 600)
            x += b[a : a + rng.choice([150, 199, 200, 201, 250, 333, 340, 600])] if k < 0.5 else rng.choice("xyz") * rng.randint(1, 450) if k < 0.7 else "".join(rng.choice("ijklmné") for _ in range(rng.randint(1, 300)))
        docs.append((i if i % 50 else None, x if i % 37 else None))
    docs.append((7, docs[7][1]))
    df = spark.createDataFrame([(*d, "z", 1) for d in docs], "doc_id long, text string, kept string, block long").repartition(3)
    assert sorted(map(tuple, substrings.remove_repeats(df).collect()), key=str) == brute_substrings(docs)
    assert substrings.remove_repeats(df.limit(0)).count() == 0


# -- lines


def brute_lines(docs, t=3):
    first, gone = {}, {}
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0))
    place = lambda i, s: (docs[i][0] is not None, docs[i][0] or 0, s)
    split = [None if x is None else x.split("\n") for _, x in docs]
    for i in order:
        for s in range(len(split[i] or []) - t + 1):
            run = tuple(split[i][s : s + t])
            first[run] = min(first.get(run, place(i, s)), place(i, s))
    for i in order:
        for s in range(len(split[i] or []) - t + 1):
            if first[tuple(split[i][s : s + t])] < place(i, s):
                gone.setdefault(i, set()).update(range(s, s + t))
    return sorted(((str(d), None if x is None else "\n".join(v for k, v in enumerate(split[i]) if k not in gone.get(i, ()))) for i, (d, x) in enumerate(docs)), key=str)


def test_lines(spark):
    rng = random.Random(8)
    docs = [(i, "\n".join(rng.choice(["a", "b", "c", "d", "", "the same long line"]) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "x\n" * 4000 + "y"), (None, "a\nb\nc\nd\na"), (103, "a\nb\nc\nd\na")]
    df = spark.createDataFrame([(*d, 5, "s") for d in docs], "doc_id long, text string, n_lines int, starts string")
    out = lines.dedup_lines(df)
    got = sorted(((str(r["doc_id"]), r["text"]) for r in out.collect()), key=str)
    assert got == brute_lines(docs) and "starts" in out.columns
    assert lines.dedup_lines(df.limit(0)).count() == 0
    twice = lines.dedup_lines(df.where("doc_id = 103").unionAll(df.where("doc_id = 103"))).collect()
    assert [r["n_removed"] for r in twice] == [0, 0]


# -- n-gram Jaccard


def brute_jaccard(docs):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)]))
    comp = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 80 * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                comp = [comp[j] if c == comp[i] else c for c in comp]
    least = {}
    for (d, _), c in zip(docs, comp, strict=True):
        least[c] = min(least.get(c, d), d)
    return sorted((d, len(s), least[c]) for (d, _), s, c in zip(docs, sets, comp, strict=True))


def test_jaccard(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(4, 120))] for _ in range(12)]
    passage = [rng.choice(words) for _ in range(40)]
    docs = []
    for i in range(240):
        t = list(rng.choice(base)) if rng.random() < 0.8 else [rng.choice(words) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            if t:
                t[rng.randrange(len(t))] = rng.choice(words)
        if rng.random() < 0.3:
            t += passage
        docs.append((i, (" " if i % 2 else "\t").join(w.upper() if i % 3 == 0 else w for w in t)))
    docs += [(900, None), (901, ""), (902, "a b"), (903, "A\nb"), (904, "a b c"), (905, "É b"), (906, "é b")]
    df = spark.createDataFrame([(*d, 1, "c") for d in docs], "doc_id long, text string, n long, cls string").repartition(4)
    want = brute_jaccard(docs)
    for pivots, heavy, counters in ((32, 1000, 1 << 22), (2, 5, 64)):
        monkeypatch.setattr(jaccard, "PIVOTS", pivots)
        monkeypatch.setattr(jaccard, "HEAVY", heavy)
        monkeypatch.setattr(jaccard, "COUNTERS", counters)
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect()) == want
    assert {r["doc_id"] for r in jaccard.keep_one(df).collect()} == {c for _, _, c in want}
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_jaccard_pairs_stay_few(spark, monkeypatch):
    """2,000 unlinked documents with a common passage, 300 with one shingle in common, 600 variants of one text."""
    rng = random.Random(5)
    word = lambda: f"v{rng.randrange(10**9)}"
    passage, five, base = [word() for _ in range(20)], [word() for _ in range(5)], [word() for _ in range(100)]
    docs = [(i, passage + [word() for _ in range(30)]) for i in range(2000)]
    docs += [(3000 + i, five + [word() for _ in range(rng.randint(1, 4))]) for i in range(300)]
    for i in range(600):
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(100)] = word()
        docs.append((5000 + i, t))
    seen = []
    plain = jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, texts: (seen.append(pairs.count()), plain(pairs, texts))[1])
    for counters, heavy in ((1 << 22, 1000), (64, 200)):  # the second: counters too few to tell what is common
        monkeypatch.setattr(jaccard, "COUNTERS", counters)
        monkeypatch.setattr(jaccard, "HEAVY", heavy)
        seen.clear()
        out = jaccard.jaccard_components(spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string")).collect()
        assert sum(seen) < 2 * len(docs), seen
        assert all(r["component_id"] == r["doc_id"] for r in out if r["doc_id"] < 5000)
        assert collections.Counter(r["component_id"] for r in out if r["doc_id"] >= 5000).most_common(1)[0][1] > 300


def test_jaccard_repeated_ids(spark):
    w = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(w)), (1, " ".join(w[:30])), (2, " ".join(w[:59])), (None, " ".join(w[:29])), (None, " ".join(w).upper())]
    out = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in out} == {1} and len(out) == 5


def test_short_runs_of_many_words(spark):
    say = lambda n, tag: " ".join(f"{tag}{i}" for i in range(n))
    one, half, fifty = say(51, "a"), say(26, "b"), say(50, "c")
    texts = ["x\n" + one, f"{half}\n{half}!", fifty, f"y\n{one}\nz", f"u\n{half}\n{half}!\nv", fifty, one, f"{half}\nw", f"{one}\n{one}", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in lines.dedup_lines(df).collect()}
    want = dict(enumerate([(x, 0) for x in texts]))
    want |= {3: ("y\nz", 1), 4: ("u\nv", 2), 6: ("", 1), 8: ("", 2)}
    assert got == want
    assert {r["n_removed"] for r in lines.dedup_lines(df, words=None).collect()} == {0}


def test_passage_oracle(spark):
    assert same_rows(spark, queries()["op4_passage_dedup"], oracle_sql()["op4_passage_dedup"])


# -- chroma


def tone(notes, rate=2000, note=256, noise=0.0, seed=0, lead=0):
    import wave

    rng, t = np.random.default_rng(seed), np.arange(note) / rate
    x = np.concatenate([np.zeros(lead), *[np.sin(2 * np.pi * 110 * 2 ** (1 + k / 12) * t) for k in notes]]) * 90
    x = np.clip(x + rng.normal(0, 90 * noise, len(x)), -120, 120)
    f = io.BytesIO()
    with wave.open(f, "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(rate)
        w.writeframes((x + 128).astype(np.uint8).tobytes())
    return f.getvalue()


def test_chroma(spark):
    rng = np.random.default_rng(2)
    one, two = rng.integers(0, 12, 64), rng.integers(0, 12, 64)
    rows = [(1, tone(one), "x"), (2, tone(one), "x"), (3, tone(one, noise=0.02), "x"), (4, tone(one, lead=128 * 10), "x"), (5, tone(two), "x"), (6, None, "x"), (7, b"no audio", "x"), (8, tone(one[:2]), "x"), (None, tone(one), "x"), (5, tone(two), "x")]
    df = spark.createDataFrame(rows, "rec_id long, audio binary, fp string")
    got = {r["rec_id"]: r for r in chroma.align(chroma.fingerprints(df)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert got[2]["copy_of"] == 1 and got[2]["class_id"] == got[3]["class_id"] == got[4]["class_id"] == 1
    assert got[3]["match_id"] == 1 and got[3]["frame_offset"] == 0 and got[3]["bit_error"] < 0.2
    assert got[4]["match_id"] == 1 and got[4]["frame_offset"] == 10
    assert got[5]["match_id"] is None and got[5]["class_id"] == 5 and got[7]["copy_of"] == 6 and got[8]["match_id"] is None
    assert chroma.align(chroma.fingerprints(df.limit(0))).count() == 0


def test_chroma_votes_for_every_holder(spark):
    rng = np.random.default_rng(7)
    base = [int(x) for x in rng.integers(-(2**31), 2**31, 40)]
    junk = lambda n: [int(x) for x in rng.integers(-(2**31), 2**31, n)]
    # 10 shares all its keys with 9, but the first holders of these are 1 to 8, with 2 pairs each: too few votes
    parts = [(i, junk(20) + base[5 * (i - 1) : 5 * (i - 1) + 3] + junk(20)) for i in range(1, 9)]
    worse = [x ^ 0x0F0F0F0F for x in base]
    # 20 shares 10 pairs with 9 and 10, but their bits differ too much over the whole overlap
    near = base[:6] + [x ^ 1 for x in base[6:]]
    far = junk(30) + base[25:36] + junk(40)
    rows = [*parts, (9, base), (10, [*base[:39], base[39] ^ 1]), (11, near), (20, far), (21, [*near[:25], *base[25:36], *near[36:]]), (30, worse)]
    df = spark.createDataFrame([(i, len(fp), fp) for i, fp in rows], "rec_id long, n_frames long, fp array<int>")

    def plain():
        keys = {i: {k: n for n, k in reversed(list(enumerate(zip(fp, fp[1:]), 1)))} for i, fp in rows}
        fps, found, links = dict(rows), {}, []
        for a, b in [(a, b) for a in fps for b in fps if b < a]:
            for shift, n in collections.Counter(keys[a][k] - keys[b][k] for k in keys[a].keys() & keys[b].keys()).items():
                x, y = fps[a][max(shift, 0) :], fps[b][max(-shift, 0) :]
                m = min(len(x), len(y))
                error = sum(((p ^ q) & 0xFFFFFFFF).bit_count() for p, q in zip(x, y)) / (32 * m)
                if n >= 3 and error <= 0.35:
                    found[a] = min(found.get(a, (0,)), (-n, b, shift, error))
                    links.append((a, b))
        group = {i: i for i in fps}
        for _ in fps:
            for a, b in links:
                group[a] = group[b] = min(group[a], group[b])
        return {i: (*((found[i][1], found[i][2], -found[i][0]) if i in found else (None,) * 3), group[i]) for i in fps}

    for more in ({}, {"share": 1}):
        got = {r["rec_id"]: (r["match_id"], r["frame_offset"], r["votes"], r["class_id"]) for r in chroma.align(df, **more).collect()}
        assert got == plain()
    assert got[10][:3] == (9, 0, 38) and got[20] == (None, None, None, 9)


def test_chroma_tells_no_pairs_of_a_group(spark, monkeypatch):
    """Of 120 near copies every two match; tables that are written hold a few rows for each recording, not one for each pair."""
    rng = np.random.default_rng(3)
    base, n = rng.integers(-(2**31), 2**31, 40), 120
    prints = [np.where(rng.random(40) < 0.1, base ^ 1, base).tolist() for _ in range(n)]
    keys = [dict(zip(zip(fp, fp[1:]), range(40))) for fp in prints]
    votes = lambda a, b: sum(b.get(k) == at for k, at in a.items())
    best = {a: max((votes(keys[a], keys[b]), -b) for b in range(a)) for a in range(1, n)}
    written, cut = [], chroma.cut
    monkeypatch.setattr(chroma, "cut", lambda df, *more: (written.append(out := cut(df, *more)), out)[1])
    monkeypatch.setattr(chroma, "drop", lambda *frames: None)
    df = spark.createDataFrame([(i, 40, fp) for i, fp in enumerate(prints)], "rec_id long, n_frames long, fp array<int>")
    got = {r["rec_id"]: r for r in chroma.align(df).collect()}
    assert len(got) == n and {r["class_id"] for r in got.values()} == {0}
    assert all((got[a]["votes"], -got[a]["match_id"]) == best[a] for a in best if best[a][0] >= 3 and got[a]["copy_of"] == a)
    assert max(df.count() for df in written) <= 2 * 8 * n < n * (n - 1) // 2


def test_chroma_blocks_in_any_lots(monkeypatch):
    rng = np.random.default_rng(4)
    prints = [rng.integers(0, 5, rng.integers(2, 60)).astype(np.int32) for _ in range(60)]
    ids, sizes, half = rng.permutation(60), np.array([len(fp) for fp in prints]), np.arange(60) < 30
    runs = []
    for at_once in (1_000_000, 50, 1):
        monkeypatch.setattr(chroma, "AT_ONCE", at_once)
        runs.append([chroma.block_matches(ids, sizes, np.concatenate(prints), a, b, 3, 0.5) for a, b in ((half, half), (half, ~half), (~half, half))])
    for run in runs:
        assert [[c.tolist() for c in best] for best, _ in run] == [[c.tolist() for c in best] for best, _ in runs[0]]
        assert [len(links[0]) for _, links in run] == [len(links[0]) for _, links in runs[0]] and len(run[0][0][0])
    assert [c.tolist() for c in runs[0][1][0]] == [c.tolist() for c in runs[0][2][0]]  # either way round


def test_chroma_finds_altered_copies(spark):
    """Recordings of the query's own table that come again shifted, noisy or cut are in their originals' classes."""
    ids = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    out = {r["rec_id"]: r["class_id"] for r in chroma.align(chroma.fingerprints(chroma.sonify(ids, altered_every=4))).collect()}
    pairs = [(out[i], out[-1 - i]) for i in out if -1 - i in out and i >= 0]
    assert len(pairs) > 100 and sum(a == b for a, b in pairs) >= 0.95 * len(pairs)


def test_fingerprint_is_the_filters_by_definition():
    c = chroma.chroma(2000, np.random.default_rng(1).normal(size=6000).astype(np.float32))
    got = chroma.fingerprint(c)
    kind, p, h, w = chroma.FILTERS[0]
    assert kind == 0
    for t in range(len(got)):
        a, b = c[t : t + w, p : p + h].sum(), c[t : t + w].sum() / 12 * h
        level = int(np.clip(np.floor(np.log((1 + a) / (1 + b)) / chroma.STEP) + 2, 0, 3))
        assert (int(got[t]) & 0xFFFFFFFF) >> 30 == chroma.GRAY[level]


# -- nearest neighbours


def test_search(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[50:90] = x[49]
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)]
    rows += [(1000, None, "c"), (1020, [0.0] * 16, "c"), (1040, [float("nan")] * 16, "c"), (1060, [None] * 16, "c"), (1080, [float("inf")] * 16, "c"), (None, [1.0] * 16, "c"), (60, x[60].tolist(), "c")]
    out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string"), rerank=400).collect()
    got = collections.defaultdict(dict)
    for r in out:
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(got) == list(range(0, 400, 20))
    exact = x.astype(float) @ x.astype(float).T
    for q in got:
        want = sorted((i for i in range(400) if i != q), key=lambda i: (-round(exact[q, i], 9), i))[:20]
        assert [got[q][k][0] for k in range(1, 21)] == want
        assert all(abs(got[q][k][1] - exact[q, want[k - 1]]) < 1e-9 for k in range(1, 21))
    few = ann.search(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>, rank string")).collect()
    assert [(r["query_id"], r["rank"]) for r in few] == [(0, 1), (0, 2)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>, rank string")).count() == 0


def test_search_doubles_repeats_and_lengths(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 6)) * 1e100
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(500, [1e100] * 5), (520, [1e100] * 7), (40, (x[40] * 2).tolist()), (40, (x[40] * -3).tolist()), (40, (x[40] * 2).tolist())]
    known = [(i, tuple(v)) for i, v in rows] + [(i, tuple(v)) for i, v in odd[2:4]]  # of one id, each vector is a row; equal rows are one
    for exact in (False, True):
        out = ann.search(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"), rerank=220, exact=exact).collect()
        assert {r["query_id"] for r in out} == set(range(0, 200, 20)) and len(out) == 240
        want = collections.Counter()
        for row in known:
            if row[0] % 20 == 0:
                s = {r: sum(a / 1e100 * (b / 1e100) for a, b in zip(row[1], r[1], strict=True)) for r in known if r != row}
                want.update((row[0], n, r[0]) for n, r in enumerate(sorted(s, key=lambda r: (-s[r], r[0]))[:20], 1))
        assert collections.Counter((r["query_id"], r["rank"], r["vec_id"]) for r in out) == want


def test_search_finds_another_row_of_a_repeated_id(spark):
    """The second row of id 7 holds the vector that is nearest to query 0."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(100, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, (9 * x[0]).tolist())]
    best = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("query_id = 0 AND rank = 1").collect()
    assert [r["vec_id"] for r in best] == [7]


def test_many_code_blocks_in_few_tasks(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(900, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, ann.search(df, exact=True).collect()))
    monkeypatch.setattr(ann, "CODE_BLOCK", 7)
    assert [(*r[:3], round(r[3], 9)) for r in sorted(map(tuple, ann.search(df, exact=True).collect()))] == [(*r[:3], round(r[3], 9)) for r in want]
    got = {(r["query_id"], r["vec_id"]) for r in ann.search(df).collect()}
    assert len(got & {(r[0], r[2]) for r in want}) >= 0.9 * len(want)


def test_search_recall_with_few_reranked(spark):
    """Of 10,000 candidates 64 are looked at exactly: recall against exact search."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(50, 32))
    x = centres[rng.integers(0, 50, 10_000)] + 0.4 * rng.normal(size=(10_000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    near = {(r["query_id"], r["vec_id"]) for r in ann.search(df, rerank=64).collect()}
    true = {(r["query_id"], r["vec_id"]) for r in ann.search(df, exact=True).collect()}
    assert len(near) == len(true) == 10_000 and len(near & true) >= 0.9 * len(true)


def test_search_recall(spark):
    """Recall against brute force, with the query's own parameters on its own table."""
    out = queries()["op8_additive_quantisation"](spark, "/root/testdata/sf0.1").toPandas()
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x, ids = np.array(t["embedding"].tolist(), float), t["vec_id"].to_numpy()
    hit = n = 0
    for q, g in out.groupby("query_id"):
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        hit, n = hit + (g["score"] >= np.sort(s)[-20] - 1e-9).sum(), n + 20
    assert n == 20 * (ids % 20 == 0).sum() and hit / n >= 0.9


@pytest.mark.parametrize("rows", ["spread", "integers"])
def test_search_misses_nothing_whatever_the_rows(spark, monkeypatch, rows):
    """Codes fitted to few rows that tell little about the others, and products that tie: all of brute force's rows."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(6000, 128)) if rows == "spread" else rng.integers(-1, 2, size=(6000, 12)).astype(float)
    x = x[np.abs(x).sum(1) > 0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "TRAIN", 300)
    got = collections.defaultdict(list)
    for r in sorted(map(tuple, ann.search(df).collect())):
        got[r[0]].append((r[2], r[3]))
    for q in range(0, len(x), 20):
        s = np.zeros(len(x))
        for j in range(x.shape[1]):
            s += x[:, j] * x[q, j]
        want = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:20]
        assert got[q] == [(i, s[i]) for i in want]


def test_small_tables(spark):
    """Queries that SQL can't express, over the smallest tables: one row for each document."""
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for name in ("op3_suffix_dedup", "op5_ngram_jaccard"):
        assert queries()[name](spark, SMALL).count() == n
