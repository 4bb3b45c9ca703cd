"""Language id, toxicity, BPE, mixing and the pipeline: held-out accuracy, exact round trips, SQL and brute force."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from civicledger.llm import bpe, langid, mixing, toxicity
from civicledger.llm.registry import oracle_sql, queries

from ..conftest import SMALL, same_rows

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, size long, taken int, _copies int, score double, h string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in all columns, empty and long texts, ties, repeated rows, and columns named like the operators' own."""
    rows = [
        (1, "Der Hund und die Katze sind in dem Haus und nicht auf der Straße. " * 40, "de", "a"), (2, "the dog and the cat are in the house and not on the street. " * 40, "en", "a"), (3, None, "en", None), (4, "", None, "b"),
        (5, "12 34 !!", "en", "b"), (None, "the end of the day", "en", "b"), (7, "the cat", None, None), (7, "the cat", None, None), (8, "the " * 30000, "en", "a"), (9, "\x1c a　b c \n", "en", ""),
    ]
    return spark.createDataFrame([(*r, 9, 9, 9, 0.5, "x") for r in rows], DOCS)


def test_codec_is_tiktoken():
    import tiktoken

    ranks = bpe.load_ranks(PATH)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own, rng, span = bpe.Codec(ranks, public_tokenizers.PATTERN), random.Random(3), bpe.SPAN
    bits = ["a", "b", " ", "\n", "é", "'", "s", "re", "1", "aaaa", "  ", "ing", " the", "\t", "　", "\x1c", "ß", "漢", "😀", "-", "<|endoftext|>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 100))) for _ in range(300)] + [rng.choice(bits) * rng.randint(1, 3000) for _ in range(60)] + ["".join(rng.choice("ab") for _ in range(2500)) for _ in range(20)]
    try:
        for bpe.SPAN in (16, span):
            for t in texts:
                got = own.encode(t)[1:]
                ids = [int(x) for x in got.split(",")] if got else []
                assert ids == plain.encode_ordinary(t), repr(t[:80])
                assert own.decode(ids) == t.encode()
    finally:
        bpe.SPAN = span


def test_join_is_associative():
    own, rng = bpe.Codec(bpe.load_ranks(PATH), public_tokenizers.PATTERN), random.Random(4)
    for _ in range(100):
        raw = bytes(rng.choice(b"abcdeting") for _ in range(rng.randint(3, 200)))
        i, j = sorted((rng.randint(0, len(raw)), rng.randint(0, len(raw))))
        a, b, c = (own.leaf(x) if x else [] for x in (raw[:i], raw[i:j], raw[j:]))
        assert own.join(own.join(a, b), c) == own.join(a, own.join(b, c)) == own.leaf(raw)


def test_bpe_rows(spark, odd):
    rows = bpe.encode_documents(odd, PATH, public_tokenizers.PATTERN, ids=True).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    assert len(rows) == 10
    for r in rows:
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        assert r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    right, n = out.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 100 and right / n > 0.97


def test_language_id_edges(spark, odd):
    rows = langid.identify(odd).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
    assert [by[i][0]["lang_pred"] for i in (3, 4, 5)] == ["und"] * 3
    assert by[7][0] == by[7][1]
    only = langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in only] == ["und"]


def test_codewords_decode_through_one_wrong_bit():
    for k in (2, 4, 6, 9):
        code = langid.codewords(k)
        assert len({tuple(r) for r in code}) == k
    code = langid.codewords(4)
    for i, word in enumerate(code):
        for b in range(len(word)):
            bad = word.copy()
            bad[b] *= -1
            assert (code @ bad).argmax() == i


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    out = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out")
    hit, toxic, wrong, clean = out.agg(F.sum(F.expr("int(toxic = 1 AND predicted = 1)")), F.sum("toxic"), F.sum(F.expr("int(toxic = 0 AND predicted = 1)")), F.sum(F.expr("1 - toxic"))).first()
    assert hit / toxic > 0.7 and wrong / clean < 0.01


def test_counterfactual_penalty_frees_group_terms(spark):
    rng, words = random.Random(5), [f"w{i}" for i in range(60)]
    rows = []
    for i in range(600):
        toxic = i % 2
        text = rng.sample(words, 12) + (["scum"] if toxic and rng.random() < 0.7 else []) + (["muslims"] if rng.random() < (0.6 if toxic else 0.05) else [])
        rows.append((i, " ".join(text), toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    fair, plain = toxicity.fit(df, balance=20.0), toxicity.fit(df, balance=0.0)
    neutral = "the muslims of the city " + " ".join(words[:10])
    assert fair.score(neutral) < plain.score(neutral) - 0.05
    assert abs(fair.score(neutral) - fair.score(neutral.replace("muslims", "christians"))) < abs(plain.score(neutral) - plain.score(neutral.replace("muslims", "christians")))
    assert fair.score("scum " + " ".join(words[:10])) > 0.7


def test_toxicity_edges(spark, odd):
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (2, 1, 0), (None, 0, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.classify(odd, labels).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert len({r["score"] for r in toxicity.classify(odd, labels.limit(0)).collect()}) == 1
    model = toxicity.Model({"cat": 9.0}, -2.0)
    kept = toxicity.drop_toxic(odd, model)
    want = sorted(str(r["doc_id"]) for r in odd.collect() if model.score(r["text"]) < 0.7)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == want and 0 < len(want) < 10


def test_mixing_oracle(spark):
    same_rows(spark, queries()["op9_mix_sources"], oracle_sql()["op9_mix_sources"], "/root/testdata/sf0.01")


def water_fill(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        extra = {s: left * w[s] / total for s in open_}
        left = 0.0
        for s, x in extra.items():
            target[s] += x
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def test_mixing_targets_and_taken(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 9)), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(800)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = {}
    for r in out:
        sizes[r["source"]] = r["source_size"]
    want = water_fill(sizes)
    for s in sizes:
        own = [r for r in out if r["source"] == s]
        assert abs(own[0]["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 9
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in own)


def test_mixing_edges(spark, odd):
    out = mixing.mix(odd).collect()
    assert len(out) == 10 and {r["size"] for r in out if r["doc_id"] in (3, 4)} == {0}
    twice = [r for r in out if r["doc_id"] == 7]
    assert twice[0] == twice[1]
    assert sorted(map(str, mixing.mix(odd).collect())) == sorted(map(str, out))
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r["copies"] for r in out)
    zero = mixing.mix(odd.withColumn("text", F.lit(""))).collect()
    assert {r["target"] for r in zero} == {0.0} and {r["taken"] for r in zero} == {0}


def test_mixing_ids_that_recur_in_two_sources(spark):
    rows = [(i % 20, " ".join(["w"] * (100 if s == "a" else 1)), s) for s in "ab" for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {(r["source"], r["doc_id"]): r["copies"] for r in mixing.mix(docs).collect()}
    got = {}
    for r in mixing.mixed_documents(docs).collect():
        got[r["source"], r["doc_id"]] = got.get((r["source"], r["doc_id"]), 0) + 1
    assert got == {k: n for k, n in want.items() if n}


def test_bpe_trees_are_used(monkeypatch):
    """Texts of the tables are halved, pre-tokens too, and joins of halves give what the merges give."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    own, joins, halves = bpe.Codec(bpe.load_ranks(PATH), public_tokenizers.PATTERN), [0], [0]
    join, split = own.join, own.split
    own.join = lambda a, b: (joins.__setitem__(0, joins[0] + 1), join(a, b))[1]
    own.split = lambda t: (halves.__setitem__(0, halves[0] + 1), split(t))[1]
    got = [own.encode(t or "") for t in texts]
    assert joins[0] > 100 and halves[0] > 2 * len(texts)
    monkeypatch.setattr(bpe, "LEAF", 1 << 20)
    monkeypatch.setattr(bpe, "SPAN", 1 << 30)
    plain = bpe.Codec(own.ranks, public_tokenizers.PATTERN)
    assert got == [plain.encode(t or "") for t in texts]
    long = [int(x) for x in got[0][1:].split(",")] * 50
    assert plain.decode(long) == b"".join(plain.bytes_of[x] for x in long)


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert langid.identify(none).count() == toxicity.classify(none, labels).count() == mixing.mix(none).count() == 0
    assert bpe.encode_documents(none, PATH, public_tokenizers.PATTERN).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as cp
    from civicledger.llm import jaccard, lines
    from civicledger.llm.common import cut

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES:
        before = docs
        docs = cut(stage(spark, docs, SMALL), f"test-{name}")
        seen[name] = (before, docs)
        assert name == cp.STAGES[-1][0] or docs.columns == columns
    before, after = seen["toxicity"]
    model = toxicity.learn(before, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect() if model.score(r["text"]) < 0.7}
    before, after = seen["line_dedup"]
    assert after.count() == before.count() and {(r["doc_id"], r["text"]) for r in after.collect()} == {(r["doc_id"], r["text"]) for r in lines.dedup_lines(before).collect()}
    before, after = seen["ngram_jaccard"]
    assert {r["doc_id"] for r in after.collect()} == {r["component_id"] for r in jaccard.jaccard_components(before).collect()}
    before, after = seen["mixing"]
    assert after.count() == sum(r["copies"] for r in mixing.mix(before).collect())
    before, after = seen["byte_bpe"]
    assert after.count() == before.count() and cp.ORACLE_SQL is None
    assert cp.run(spark, SMALL).count() == after.count()
