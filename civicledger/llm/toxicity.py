"""Counterfactual-regularised toxicity classifier.

A logistic model over words and word beginnings. For every training text that names a group of people, two twins
are made: one in which the group terms are swapped for others, one without them. Beside the log loss, training
pays for the squared differences between the scores of a text and its twins. Terms that merely name a group so
get no weight of their own, and neutral mentions aren't flagged.

Learning reads a bounded sample of labelled rows (`sample` of them for each label, the first by hash); feature
counts are summed by Spark, and only the chosen features of the sampled rows come to the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table, text_batches, worker_cache

WORDS = re.compile(r"\w+")
#: Group terms of the four languages, lower case; each is swapped for the one at the same distance in its list.
IDENTITY = {
    "en": ["women", "men", "muslims", "christians", "jews", "hindus", "immigrants", "refugees", "gays", "lesbians", "blacks", "whites", "asians", "disabled", "elderly", "muslim", "christian", "jewish", "gay", "lesbian", "black", "white", "asian", "woman", "man", "transgender", "latino", "african"],
    "de": ["frauen", "männer", "muslime", "christen", "juden", "einwanderer", "flüchtlinge", "schwule", "behinderte", "ausländer"],
    "fr": ["femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "réfugiés", "homosexuels", "handicapés", "étrangers"],
    "es": ["mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "refugiados", "homosexuales", "discapacitados", "extranjeros"],
}
SWAP = {w: terms[(i + 1) % len(terms)] for terms in IDENTITY.values() for i, w in enumerate(terms)}
BEGINNINGS = (3, 4, 5)
KNOWN_WORDS = 100_000  # distinct words that a scoring task remembers


def features(words) -> set[str]:
    """The distinct words and, marked by a star, their beginnings."""
    out = set(words)
    for n in BEGINNINGS:
        out.update([w[:n] + "*" for w in words if len(w) > n])
    return out


def words_of(text: str | None) -> set[str]:
    return set(WORDS.findall((text or "").lower()))


def feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, toxic, clean): in how many sampled texts of either label each feature is."""

    def run(batches):
        import pyarrow as pa

        worker_cache("toxicity")
        counts: dict[str, list[int]] = {}
        for batch in text_batches(batches):
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in features(words_of(text)):
                    counts.setdefault(f, [0, 0])[label] += 1
        if counts:
            clean, toxic = zip(*counts.values(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(toxic, pa.int64()), pa.array(clean, pa.int64())], ["feature", "toxic", "clean"])

    rows = sample.select("toxic", "text").mapInArrow(run, "feature string, toxic bigint, clean bigint")
    return rows.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose(counts: DataFrame, n_toxic: int, n_clean: int, most: int) -> list[str]:
    """The `most` features of largest chi-square against the label, ties by name; always those of group terms."""
    t, c, n = F.col("toxic"), F.col("clean"), n_toxic + n_clean
    p = (t + c) / n
    chi = F.pow(t - p * n_toxic, 2) / (p * n_toxic) + F.pow(c - p * n_clean, 2) / (p * n_clean)
    rows = counts.where((t + c) >= 3).select("feature", chi.alias("chi")).orderBy(F.desc("chi"), "feature").limit(most)
    return sorted({r["feature"] for r in rows.collect()} | features(SWAP))


class Model:
    def __init__(self, weights: dict[str, float], bias: float):
        self.bias, self.weights, self.known = bias, weights, {}

    def gist(self, word: str) -> tuple[str, ...]:
        """The model's features of a word."""
        return tuple(f for f in (word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)) if f in self.weights)

    def score(self, text: str | None) -> float:
        import math

        known, found = self.known, set()
        for w in words_of(text):
            gist = known.get(w)
            if gist is None:
                if len(known) > KNOWN_WORDS:
                    known.clear()
                gist = known[w] = self.gist(w)
            if gist:
                found.update(gist)
        z = self.bias + math.fsum(map(self.weights.__getitem__, found))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def fit(labelled: DataFrame, sample: int = 6000, most: int = 3000, balance: float = 2.0, ridge: float = 1e-5, steps: int = 1000) -> Model:
    """A model from (doc_id, text, toxic 0/1): `sample` rows of label 1 and twice as many of label 0 at most.

    `balance` weighs the penalty on the difference between a text and its counterfactual twin. Without rows
    of both labels nothing can be told apart: every score is the same low one, and nothing is rejected.
    """
    import numpy as np

    rank = F.xxhash64(F.col("doc_id").cast("string"))
    ones = labelled.where("toxic = 1").orderBy(rank, "doc_id").limit(sample)
    zeros = labelled.where("toxic = 0").orderBy(rank, "doc_id").limit(2 * sample)
    chosen = ones.select("doc_id", "toxic").union(zeros.select("doc_id", "toxic"))
    # the ids of the sample are bounded by its parameter; their texts are met where they are
    picked = {1: [], 0: []}
    for r in chosen.collect():
        picked[r["toxic"]].append(r["doc_id"])
    spark, kind = labelled.sparkSession, dict(labelled.dtypes)["doc_id"]
    n1, n0 = len(picked[1]), len(picked[0])
    if not n1 or not n0:
        return Model({}, -3.0)
    ids = spark.createDataFrame([(i,) for x in picked.values() for i in x if i is not None], f"_id {kind}").distinct()
    rows = labelled.join(F.broadcast(ids), F.col("doc_id") == F.col("_id"), "left_semi").select("toxic", "text")
    names = choose(feature_counts(rows), n1, n0, most)
    index = {f: i for i, f in enumerate(names)}

    def sparse(batches):
        import pyarrow as pa

        for batch in text_batches(batches):
            own, twin, bare = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                own.append(sorted(index[f] for f in features(words) if f in index))
                named = not words.isdisjoint(SWAP)
                twin.append(sorted(index[f] for f in features({SWAP.get(w, w) for w in words}) if f in index) if named else own[-1])
                bare.append(sorted(index[f] for f in features(words - SWAP.keys()) if f in index) if named else own[-1])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, kind) for x in (own, twin, bare))], ["toxic", "own", "twin", "bare"])

    got = rows.mapInArrow(sparse, "toxic int, own array<int>, twin array<int>, bare array<int>").toPandas()
    got["key"] = [tuple(x) for x in got["own"]]
    got = got.sort_values(["key", "toxic"], kind="stable")  # the order of tasks must not matter
    y = got["toxic"].to_numpy(float)

    def flat(lists):
        lists = list(lists)
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate([np.asarray(x, np.int64) for x in lists]) if lists else np.zeros(0, np.int64)

    r1, c1 = flat(got["own"])
    # only texts that name a group have twins of their own; for the others the penalty is nothing
    other = np.flatnonzero([a != tuple(b) or a != tuple(c) for a, b, c in zip(got["key"], got["twin"], got["bare"], strict=True)])
    twins = [flat(got[name].iloc[other]) for name in ("twin", "bare")]
    n, k = len(y), len(names)
    share = np.where(y > 0, n / (2 * y.sum()), n / (2 * (n - y.sum())))  # both labels weigh the same
    w, b = np.zeros(k), 0.0
    m, v = np.zeros(k + 1), np.zeros(k + 1)

    def chance(z):
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    for step in range(1, steps + 1):  # Adam on log loss + balance * (score - twin's score)^2 + ridge * |w|^2
        p1 = chance(np.bincount(r1, w[c1], n) + b)
        g1 = (p1 - y) * share / n
        g, gb = 2 * ridge * w, 0.0
        for r2, c2 in twins if len(other) else ():
            p2 = chance(np.bincount(r2, w[c2], len(other)) + b)
            gap = 2 * balance * (p1[other] - p2) / n
            g1[other] += gap * p1[other] * (1 - p1[other])
            g2 = -gap * p2 * (1 - p2)
            g, gb = g + np.bincount(c2, g2[r2], k), gb + g2.sum()
        g = np.append(g + np.bincount(c1, g1[r1], k), gb + g1.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        d = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - d[:-1], b - d[-1]
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-3}, float(b))


def score(docs: DataFrame, model: Model, cut_off: float = 0.7, keep=("doc_id",)) -> DataFrame:
    """`keep` columns, score (0 to 1) and predicted (1 from `cut_off` on) of every whole text; null is empty."""
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", score double, predicted int"

    def run(batches):
        import pyarrow as pa

        worker_cache("toxicity")
        for batch in text_batches(batches):
            s = [model.score(t) for t in batch.column(len(keep)).to_pylist()]
            out = [*(batch.column(i) for i in range(len(keep))), pa.array(s, pa.float64()), pa.array([int(x >= cut_off) for x in s], pa.int32())]
            yield pa.RecordBatch.from_arrays(out, [*keep, "score", "predicted"])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: Model, cut_off: float = 0.7) -> DataFrame:
    """Rows of `docs`, all columns, that score below `cut_off`."""
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        worker_cache("toxicity")
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                yield part.filter(pa.array([model.score(t) < cut_off for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learn(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, **how) -> Model:
    """Fit on the labelled rows outside the held-out fold. A doc_id with several labels counts as toxic if one says so."""
    known = labels.where((crc_mod(F.col("doc_id"), folds) != held) & F.col("toxic").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumnRenamed("doc_id", "_lid")
    rows = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("_lid")).select("doc_id", "text", "toxic")
    return fit(rows, **how)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; labels are learned outside the held-out fold only.

    Null texts are scored as empty ones. Repeated rows get equal scores; null ids are scored and never learned
    from; extra columns are never read; empty tables give an empty result, and without labels of both kinds
    every score is the same low one. Texts are scored whole, one at a time, whatever their length.
    """
    model = learn(docs, labels, folds, held)
    rows = docs.select("doc_id", (crc_mod(F.col("doc_id"), folds) == held).alias("held_out"), "text")
    return score(rows, model, keep=("doc_id", "held_out"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE: dict[str, str] = {}
