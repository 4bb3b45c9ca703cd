"""Operators against plain Python versions that share no code with them: language id, toxicity, the whole pipeline."""

import collections
import hashlib
import math
import random
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from civicledger.llm import bpe, langid, toxicity

from ..conftest import SMALL
from .test_pair_operators import brute_jaccard
from .test_text_operators import PATH, water_fill

MASK = 0xFFFFFFFF


def plain_grams(text):
    b = [48 if 48 <= x <= 57 else x + 32 if 65 <= x <= 90 else x for x in (text or "").encode()]
    out = []
    for x, y, z in zip(b, b[1:], b[2:]):
        h = (x * 0x9E3779B1 + y * 0x85EBCA6B + z * 0xC2B2AE35) & MASK
        h ^= h >> 15
        out.append(((h * 0x27D4EB2F) & MASK) >> 17)
    return out


def test_language_id_is_the_plain_decoder(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows}
    counts = collections.defaultdict(collections.Counter)
    for r in rows:
        if not held[r["doc_id"]] and r["lang"] is not None and r["text"] is not None:
            counts[r["lang"]].update(plain_grams(r["text"]))
    langs, size = sorted(counts), langid.BUCKETS
    freq = {}
    for x in langs:
        total = sum(counts[x].values()) + 0.5 * size
        freq[x] = [(counts[x][g] + 0.5) / total for g in range(size)]
    bits, seen = [], set()  # every split of the languages in two, the first language on the positive side
    for s in range(2 ** (len(langs) - 1) - 1):
        bits.append([1 if i == 0 or s >> (i - 1) & 1 else -1 for i in range(len(langs))])
    odds, trust = [], []
    for bit in bits:
        one = [sum(freq[x][g] for x, b in zip(langs, bit) if b > 0) / bit.count(1) for g in range(size)]
        zero = [sum(freq[x][g] for x, b in zip(langs, bit) if b < 0) / bit.count(-1) for g in range(size)]
        w = [math.log(p) - math.log(q) for p, q in zip(one, zero)]
        odds.append(w)
        trust.append(sum((p - q) * x for p, q, x in zip(one, zero, w)))
    whole = sum(trust)
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    for r in rows:
        g = plain_grams(r["text"])
        if not any(c.isalpha() for c in r["text"] or ""):
            assert got[r["doc_id"]]["lang_pred"] == "und" and got[r["doc_id"]]["score"] == 0
            continue
        n = max(1, len(g))
        margin = [sum(w[x] for x in g) / n * math.sqrt(min(n, 400)) for w in odds]
        loss = [sum(t / whole * math.log1p(math.exp(-m * bit[i])) for m, bit, t in zip(margin, bits, trust)) for i in range(len(langs))]
        p = [math.exp(min(loss) - x) for x in loss]
        best = loss.index(min(loss))
        one = got[r["doc_id"]]
        assert one["held_out"] == held[r["doc_id"]] and abs(one["score"] - p[best] / sum(p)) < 1e-3
        if sorted(loss)[1] - min(loss) > 1e-3:
            assert one["lang_pred"] == langs[best]
            seen.add(langs[best])
    assert len(seen) > 1


def plain_features(words):
    return {w for w in words} | {w[:n] + "*" for w in words for n in (3, 4, 5) if len(w) > n}


def test_toxicity_is_the_plain_gradient(spark):
    rng = random.Random(12)
    terms = {w: ts[(i + 1) % len(ts)] for ts in toxicity.IDENTITY.values() for i, w in enumerate(ts)}
    rows = []
    for i in range(40):
        words = rng.sample(["alpha", "bravo", "charlie", "deltas", "echoing"], 3) + (["scum"] if i % 2 and rng.random() < 0.8 else [])
        rows.append((i, " ".join(words + ([rng.choice(["women", "jews", "Gay"])] if rng.random() < 0.5 else [])), i % 2))
    steps, balance, ridge = 40, 2.0, 1e-5
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), steps=steps)
    sets = [set(re.findall(r"\w+", t.lower())) for _, t, _ in rows]
    seen = collections.Counter(f for s in sets for f in plain_features(s))
    names = {f for f, n in seen.items() if n >= 3} | plain_features(terms)
    own = [plain_features(s) & names for s in sets]
    twins = [[plain_features({terms.get(w, w) for w in s}) & names for s in sets], [plain_features(s - set(terms)) & names for s in sets]]
    other = [i for i in range(len(rows)) if any(t[i] != own[i] for t in twins)]
    y = [r[2] for r in rows]
    n, share = len(y), [len(y) / (2 * (sum(y) if v else len(y) - sum(y))) for v in y]
    w, b = dict.fromkeys(names, 0.0), 0.0
    first, second = collections.defaultdict(float), collections.defaultdict(float)
    chance = lambda f: 1 / (1 + math.exp(-(b + sum(w[x] for x in f))))
    for step in range(1, steps + 1):
        g = {f: 2 * ridge * x for f, x in w.items()} | {None: 0.0}

        def add(f, by):
            for x in (*f, None):
                g[x] += by

        p = [chance(f) for f in own]
        slope = [(q - v) * s / n for q, v, s in zip(p, y, share)]
        for t in twins:
            for i in other:
                q = chance(t[i])
                gap = 2 * balance * (p[i] - q) / n
                slope[i] += gap * p[i] * (1 - p[i])
                add(t[i], -gap * q * (1 - q))
        for f, s in zip(own, slope):
            add(f, s)
        for x, v in g.items():
            first[x], second[x] = 0.9 * first[x] + 0.1 * v, 0.999 * second[x] + 0.001 * v * v
            move = 0.05 * first[x] / (1 - 0.9**step) / (math.sqrt(second[x] / (1 - 0.999**step)) + 1e-8)
            if x is None:
                b -= move
            else:
                w[x] -= move
    assert abs(model.bias - b) < 1e-6 and set(model.weights) == {f for f, x in w.items() if abs(x) > 1e-3}
    assert max(abs(x - w[f]) for f, x in model.weights.items()) < 1e-4


def plain_lines(docs):
    """{doc_id: text} after later copies of three lines, or of one or two of more than 50 words, are gone."""
    runs, order = collections.defaultdict(list), sorted(docs)
    for d in order:
        l = (docs[d] or "").split("\n") if docs[d] is not None else []
        for n in (1, 2, 3):
            for s in range(len(l) - n + 1):
                run = "\n".join(l[s : s + n])
                if n == 3 or len(re.findall(r"[^\x20\x09-\x0D]+", run)) > 50:
                    runs[n, run].append((d, s))
    gone = collections.defaultdict(set)
    for (n, _), places in runs.items():
        for d, s in sorted(places)[1:]:
            gone[d].update(range(s, s + n))
    return {d: t if d not in gone else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs.items()}


def plain_copies(rows):
    """How often a mix takes each of (doc_id, source, size)."""
    sizes = collections.Counter()
    for _, s, n in rows:
        sizes[s] += n
    target, out = water_fill(sizes), {}
    for s in sizes:
        own = sorted((int(hashlib.md5(str(d).encode()).hexdigest()[:15], 16), d, n) for d, x, n in rows if x == s)
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        left, sum_, taken = target[s] - whole * sizes[s], 0, set()
        for _, d, n in own:
            if sum_ + n > left + 1e-9:
                if sum_ + n - left < left - sum_:
                    taken.add(d)
                break
            sum_ += n
            taken.add(d)
        out |= {d: whole + (d in taken) for _, d, _ in own}
    return out


@pytest.fixture(scope="module")
def odd_folder(spark, tmp_path_factory):
    """Tables with nulls, repeated texts, long and empty ones, and no document at all in the last."""
    path = str(tmp_path_factory.mktemp("odd"))
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "x y z", "en", None, 5), (4, "x y z", "en", "a", 5), (5, long, "en", "b", 9), (6, long + " more", "en", "b", 9), (7, "l1\nl2\nl3\nl4", "en", "a", 11), (8, "l0\nl1\nl2\nl3", "en", "a", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    docs.limit(0).write.parquet(f"{path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/none/labels.parquet")
    return path


def plain_pipeline(spark, folder):
    import tiktoken

    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.learn(docs, labels)  # checked by itself above; its decisions are made plainly here
    score = lambda t: 1 / (1 + math.exp(-(model.bias + sum(model.weights.get(f, 0.0) for f in plain_features(set(re.findall(r"\w+", (t or "").lower())))))))
    rows = {r["doc_id"]: r for r in docs.collect() if score(r["text"]) < 0.7}
    texts = plain_lines({d: r["text"] for d, r in rows.items()})
    kept = [d for d, _, least in brute_jaccard(sorted(texts.items())) if d == least]
    copies = plain_copies([(d, rows[d]["source"], len(re.findall(r"[^\x20\x09-\x0D]+", texts[d] or ""))) for d in kept])
    coder = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    out = []
    for d in kept:
        ids = coder.encode_ordinary(texts[d] or "")
        out += [(d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((texts[d] or "").encode()).hexdigest())] * copies[d]
    return sorted(out)


def test_pipeline_is_the_plain_one(spark, odd_folder):
    import corpus_pipeline as cp

    for folder in (SMALL, odd_folder):
        got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in cp.run(spark, folder).collect())
        assert got == plain_pipeline(spark, folder) and got
    assert cp.run(spark, f"{odd_folder}/none").count() == 0


def test_pipeline_keeps_clashing_columns(spark, odd_folder):
    import corpus_pipeline as cp

    names = ["_row", "_copies", "cls", "n", "h", "taken", "score", "runs", "_gone", "comp", "copies", "size"]
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet").withColumns({c: F.lit(c) for c in names})
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, odd_folder)
        assert out.columns == docs.columns
        assert all(r[c] == c for r in out.collect() for c in names)
        docs = out
