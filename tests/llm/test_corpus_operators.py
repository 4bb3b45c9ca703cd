"""Class language model, tokenizer alignment and spelling variants against plain versions, with odd tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from civicledger.llm import alignment, blocks, classlm, common, spelling, toxicity
from civicledger.llm.common import crc_mod
from civicledger.llm.registry import queries

from ..conftest import SMALL

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n int, key string, words array<string>, block long, found int"
ODD = [
    (1, "the cat and the dog and the house " * 30), (2, "The cat AND the Dogs, and thé house. " * 20), (3, None), (4, ""), (5, " \n\t "), (None, "the end of the day"), (7, "the cat"), (7, "the cat"),
    (8, "cat " * 30000), (9, "\x1c a　b c \n <|endoftext|> <s> <0x41>"), (10, "tab\tand\r\nline  two  spaces "), (11, " led by a space"), (12, "naïve café ﬁre 漢字 😀 é ½ ​ x"), (13, "\u0000 null"), (15, "good words then a▁b not given back"), (14, "housse house houses hous"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, "s", 1, "k", ["w"], 5, 6) for i, t in ODD], DOCS)


# -- class language model


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + ["\n"]


def plain_scores(rows, model, learned):
    """Base and model scores by their formulas, word by word, with the model's own classes."""
    c = collections.Counter(w for i, t in rows if learned(i) for w in tokens(t))
    n_all, n_types = sum(c.values()), len(c)
    own = {r["word"]: r["cls"] for r in model.word_classes().collect()}
    k = len(model.sizes)
    pairs, size, types = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t in rows:
        if learned(i):
            classes = [0, *(own[w] for w in tokens(t))]
            pairs.update(zip(classes, classes[1:]))
    for (_, b), n in pairs.items():
        size[b] += n
    types.update(own.values())
    one, two = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
    d = min(0.9, max(0.1, one / (one + 2 * two))) if one else 0.1

    def move(a, b):
        seen = sum((a, x) in pairs for x in range(k))
        rest = 0.5 * seen / size[a] if size[a] else 1.0
        return (max(pairs[a, b] - 0.5, 0) / size[a] if size[a] else 0) + rest * (size[b] + 0.5) / (n_all + 0.5 * k)

    other = max(range(1, k), key=lambda x: (types[x], -x))
    out = []
    for i, t in rows:
        at, base, score, words = 0, 0.0, 0.0, tokens(t)
        for w in words:
            base += math.log10((c[w] + 0.5) / (n_all + 0.5 * (n_types + 1)))
            tail = 1 + classlm.OWN + zlib.crc32(w[-3:].encode()) % classlm.TAILS
            b = own[w] if w in own else int(model.classes[tail])
            b = other if w not in own and not types[b] else b
            given = 1.0 if w == "\n" else (c[w] - d) / size[b] if w in own else d * types[b] / size[b]
            score += math.log10(move(at, b)) + math.log10(given)
            at = b
        out.append((i, len(words), sum(w in c for w in words), n_all, base, score))
    return out


def test_scores_are_their_formulas(spark, odd, monkeypatch):
    monkeypatch.setattr(classlm, "BLOCK", 2000)  # several blocks
    coded, words = classlm.prepared(odd, crc_mod(F.col("doc_id"), 5) == 1)
    model = classlm.learn(coded, words, 6, 3)
    learned = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1
    want = sorted(plain_scores(ODD, model, learned), key=str)
    got = sorted((tuple(r[c] for c in ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")) for r in classlm.told(coded, model).collect()), key=str)
    assert len(got) == len(ODD) and {r["held_out"] for r in classlm.told(coded, model).collect()} == {True, False}
    for a, b in zip(sorted(got, key=lambda r: (str(r[:4]), r[4])), sorted(want, key=lambda r: (str(r[:4]), r[4])), strict=True):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-6 * (1 + abs(b[4])) and abs(a[5] - b[5]) < 1e-6 * (1 + abs(b[5]))


def test_probabilities_sum_to_one(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    coded, words = classlm.prepared(docs, crc_mod(F.col("doc_id"), 5) == 1)
    model = classlm.learn(coded, words, 16, 3)
    assert np.allclose((10**model.transitions).sum(1), 1)
    total = collections.Counter()
    for r in model.word_classes().collect():
        total[r["cls"]] += 1.0 if r["word"] == "\n" else (r["n"] - model.discount) / model.sizes[r["cls"]]
    for c in total:
        assert abs(total[c] + 10 ** model.unknown()[c] - 1) < 1e-9
    assert model.heights == sorted(model.heights) and len(model.heights) > 1
    assert model.word_classes().where("word = '\n'").collect()[0]["cls"] == 0


def test_exchange_gains_are_those_of_the_objective():
    """For a unit without itself as a neighbour, gains differ between classes as the objective does, but for one cell."""
    rng = np.random.default_rng(1)
    pairs = rng.integers(50, 90, (5, 5)).astype(float)
    pairs += pairs.T  # a class is left as often as it is entered
    counts = {(0, 1): 3, (0, 3): 2, (1, 2): 4, (1, 4): 1}  # (side, class): n
    moved = {}
    for k in range(1, 5):
        m = pairs.copy()
        for (side, c), n in counts.items():
            m[(k, c) if side == 0 else (c, k)] += n
        moved[k] = m
    own = 1
    keys = list(counts)
    got = classlm.gains(np.array([own]), np.array([0]), np.array([s for s, _ in keys]), np.array([c for _, c in keys]), np.array([float(counts[x]) for x in keys]), moved[own])[0]
    true = {k: classlm.objective(moved[k]) for k in moved}
    for k in (2, 3, 4):
        assert abs((got[k] - got[own]) - (true[k] - true[own])) < 0.35


def test_model_beats_the_base(spark):
    r = queries()["op11_class_lm"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert 10 ** (-r["s"] / r["n"]) < 0.6 * 10 ** (-r["b"] / r["n"])


def test_model_of_nothing(spark, odd):
    assert classlm.score(odd.where("false")).count() == 0
    held = odd.where(crc_mod(F.col("doc_id"), 5) == 1)
    rows = classlm.score(held).collect()
    assert rows and all(r["base_score"] == r["score"] == 0 and r["train_tokens"] == r["n_known"] == 0 for r in rows)
    empty = classlm.score(spark.createDataFrame([(0, ""), (1, None), (2, "word"), (5, "")], "doc_id long, text string")).collect()
    assert len(empty) == 4 and all(math.isfinite(r["score"]) for r in empty)


# -- alignment


def plain_alignment(rows):
    """Token by token, by byte ends: counts, links and groups as text of each document."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    of = alignment.byte_table()
    out, documents = [], collections.Counter()
    for text in rows:
        left = a.encode(" " + text, add_special_tokens=False).ids if text else []
        right = b.encode(text) if text else []
        x = [bytes(of[c] for c in a.id_to_token(i)) for i in left]
        y = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in right]
        if not text or b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
            out.append((0, 0, 0, [], ""))
            continue
        ranges = []
        for parts in (x, y):
            at, own = 0, []
            for p in parts:
                own.append((at, at + len(p)))
                at += len(p)
            ranges.append(own)
        links = [(i, j) for i, p in enumerate(ranges[0]) for j, q in enumerate(ranges[1]) if p[0] < q[1] and q[0] < p[1]] if len(left) < 400 else None
        cuts = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
        groups, i, j, pairs = [], 0, 0, []
        for cut in cuts:
            g, h = [], []
            while i < len(left) and ranges[0][i][1] <= cut:
                g.append(i)
                i += 1
            while j < len(right) and ranges[1][j][1] <= cut:
                h.append(j)
                j += 1
            groups.append(",".join(str(left[k]) for k in g) + "|" + ",".join(str(right[k]) for k in h))
            pairs += [(left[k], right[m]) for k in g for m in h if ranges[0][k][0] < ranges[1][m][1] and ranges[1][m][0] < ranges[0][k][1]]
        assert links is None or collections.Counter((left[i], right[j]) for i, j in links) == collections.Counter(pairs)
        documents.update(set(pairs))
        out.append((len(left), len(right), len(groups), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = collections.Counter()
    for (i, _), n in documents.items():
        most[i] = max(most[i], n)
    return [(x, y, g, len(p), sum(documents[q] == most[q[0]] for q in p), sum(documents[q] for q in p), s) for x, y, g, p, s in out]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("block", [300, 8 << 20])
def test_alignment_is_the_plain_one(spark, odd, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    extra = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 2000").limit(60).collect()]
    docs = spark.createDataFrame([*ODD, *extra], "doc_id long, text string")
    want = collections.Counter(zip((i for i, _ in [*ODD, *extra]), plain_alignment([t for _, t in [*ODD, *extra]]), strict=True))
    got = collections.Counter((r["doc_id"], tuple(r[c] for c in COLUMNS)) for r in alignment.align(docs, A, B, public_tokenizers.PATTERN).collect())
    assert got == want
    assert sum(r[1][0] == 0 for r in got.elements()) >= 3


def test_alignment_of_nothing(spark, odd):
    assert alignment.align(odd.where("false"), A, B, public_tokenizers.PATTERN).count() == 0
    rows = alignment.align(odd.where("doc_id IN (3, 4)"), A, B, public_tokenizers.PATTERN).collect()
    assert [tuple(r[c] for c in COLUMNS) for r in rows] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_union_find_and_overlaps():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        cuts = [np.sort(rng.choice(np.arange(1, n), size=rng.integers(0, n), replace=False)) if n > 1 else np.zeros(0, int) for _ in range(2)]
        ends = [np.append(c, n) for c in cuts]
        lengths = [np.diff(e, prepend=0) for e in ends]
        a, b = alignment.overlaps(*lengths)
        starts = [e - x for e, x in zip(ends, lengths, strict=True)]
        assert sorted(zip(a, b, strict=True)) == [(i, j) for i in range(len(ends[0])) for j in range(len(ends[1])) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]]
        shuffled = rng.permutation(len(a))
        x, y = alignment.union_find(a[shuffled], b[shuffled], len(ends[0]), len(ends[1]))
        common = np.intersect1d(*ends)
        first = [int(np.searchsorted(ends[0], c, "right")) for c in [0, *common[:-1]]]
        assert list(x) == [first[np.searchsorted(common, e)] for e in ends[0]] and list(y) == [first[np.searchsorted(common, e)] for e in ends[1]]


def test_packed_numbers():
    rng = np.random.default_rng(3)
    x = [rng.integers(0, 1 << 32, n) for n in (0, 1, 1000)]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(x, blocks.unpack(blocks.pack(*x)), strict=True))
    assert list(blocks.spans(np.array([5, 0, 9]), np.array([2, 0, 3]))) == [5, 6, 9, 10, 11] and len(blocks.spans(np.zeros(0, int), np.zeros(0, int))) == 0


# -- spelling


def plain_variants(rows, least, letters, ratio, every=97):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    words = {w: k for w, k in n.items() if k >= least and len(w) >= letters}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found = {w: sorted((x for x in words if near(w, x)), key=lambda x: (-words[x], x)) for w in words}
    form = {w: x[0] if x and words[x[0]] >= ratio * words[w] else None for w, x in found.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (words[w], len(found[w]), form[w], words.get(form[w]), root(w)) for w in words}


def test_variants_are_the_plain_ones(spark, odd):
    text = " ".join(w for w, k in [("ministry", 40), ("ministr", 9), ("minstry", 18), ("minisstry", 4), ("minstr", 3), ("ministrÿ", 2), ("aaaa", 6), ("aaa", 12), ("aaaaa", 3), ("abaa", 3), ("Ministry", 5), ("minixstry", 1)] for _ in range(k))
    rows = [*ODD, (99, text), (100, text), (100, text), (101, "x" * 50_000 + " " + "x" * 50_001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for least, letters, ratio, every in ((3, 5, 2, 97), (1, 1, 2, 3), (2, 3, 3, 7)):
        kept = [r for r in rows if least > 1 or r[0] != 101]
        frame = docs.where("doc_id <> 101 OR doc_id IS NULL") if least == 1 else docs
        want = plain_variants(kept, least, letters, ratio, every)
        counts = spelling.count_words(frame, every)
        got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.grouped(counts, least, letters, ratio).collect()}
        assert got == want
    chain = plain_variants(rows, 3, 5, 2)
    assert any(v[4] not in (w, v[2]) for w, v in chain.items())  # a form that has a form of its own
    assert spelling.variants(odd.where("false")).count() == 0 and spelling.variants(odd.where("doc_id IN (3, 4)")).count() == 0


def test_variants_query(spark):
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in queries()["op13_spelling"](spark, SMALL).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert got == plain_variants(rows, 3, 5, 2)


def test_variants_send_no_table_by_its_file_size(spark, monkeypatch):
    """Words that compress well: their keys and roots are many times what Spark takes their files for, and aren't broadcast."""
    words = spark.range(1000).select(F.concat(F.lit("x" * 60), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("word"), (F.col("id") % 5 * 9 + 3).alias("n"))
    written = common.cut(words, "words-to-test")
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size(written) < 200_000 < 1000 * 60 * 60
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        near = spelling.near_pairs(written)
        assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(spelling, "BROADCAST_ROWS", 10)
        roots = spelling.grouped(words, 3, 5, 2)
        assert "Broadcast" not in [x for x in roots._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x][0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    monkeypatch.undo()
    few = spark.createDataFrame([("aaaa", "aaab")], "word string, root string")
    long = few.select("word", F.repeat("root", spelling.BROADCAST_LETTERS // 4).alias("root"))
    hints = lambda df: str(df._jdf.queryExecution().analyzed().toString()).lower()
    assert "broadcast" in hints(spelling.sent(few)) and "merge" in hints(spelling.sent(long)) and "broadcast" in hints(spelling.sent(few.limit(0)))


# -- toxicity of one label


def test_labels_of_one_kind_reject_nothing(spark):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(30)], "doc_id long, text string")
    for toxic in (0, 1):
        labels = spark.createDataFrame([(i, 1, toxic) for i in range(12)], "doc_id long, quality int, toxic int")
        model = toxicity.learn(docs, labels)
        assert toxicity.drop_toxic(docs, model).count() == 30
        assert all(r["predicted"] == 0 for r in toxicity.classify(docs, labels).collect())
