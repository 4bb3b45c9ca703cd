"""Language identification by error-correcting output codes over byte n-grams.

Each language has a codeword; each bit of it is one binary classifier, a naive Bayes log-odds over hashed byte
trigrams with the languages whose codeword has that bit against the rest. A document's margins on all bits are
decoded by loss: the language whose codeword has the least weighted logistic loss, each bit weighted by how far
apart its two sides are; a small gap to the second language flags the row as ambiguous.

All statistics are counts, summed over every training row by Spark; what comes to the driver is languages x
2^15 numbers, whatever the size of the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table, text_batches, text_buffer

BUCKETS = 1 << 15


def gram_ids(raw, offsets):
    """Bucket of the trigram that starts at each byte, and which of them lie within one document.

    ASCII letters are lower-cased and digits are taken as one.
    """
    import numpy as np

    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    fold[48:58] = 48
    b = fold[raw].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h = (h * np.uint32(0x27D4EB2F)) >> np.uint32(17)
    starts = np.minimum(offsets[:-1], len(h))
    ends = np.minimum(np.maximum(offsets[1:] - 2, offsets[:-1]), len(h))
    return h.astype(np.int32), (starts, ends)


def fit_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of (lang, text): each task sums its own rows, Spark sums the tasks."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for batch in text_batches(batches):
            h, spans = gram_ids(*text_buffer(batch.column(1)))
            if not len(h):
                continue
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lang in set(langs):
                own = [h[s:e] for s, e in zip(spans[0][langs == lang], spans[1][langs == lang], strict=True)]
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                sums[lang] += np.bincount(np.concatenate(own), minlength=BUCKETS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "gram", "n"])

    rows = labelled.select("lang", "text").mapInArrow(count, "lang string, gram int, n bigint")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def codewords(k: int):
    """k rows of +-1: all splits of the languages in two up to six, else random columns with distinct rows."""
    import numpy as np

    if k <= 6:
        splits = [[1 if i == 0 or (s >> (i - 1)) & 1 else -1 for i in range(k)] for s in range(2 ** (k - 1) - 1)]
        return np.array(splits, dtype=np.float32).T.reshape(k, -1)
    bits, rng = max(16, 6 * int(np.ceil(np.log2(k)))), np.random.default_rng(7)
    while True:
        code = rng.choice([-1.0, 1.0], size=(k, bits)).astype(np.float32)
        if len(np.unique(code, axis=0)) == k and (np.abs(code.sum(0)) < k).all():
            return code


class Model:
    """langs; code: languages x bits; weights: buckets x bits; trust: a weight for each bit."""

    def __init__(self, counts):
        import numpy as np

        self.langs = sorted(set(counts["lang"]))
        k = len(self.langs)
        freq = np.zeros((k, BUCKETS))
        freq[[self.langs.index(x) for x in counts["lang"]], counts["gram"]] = counts["n"]
        freq = (freq + 0.5) / (freq + 0.5).sum(1, keepdims=True) if k else freq
        self.code = codewords(k) if k else np.zeros((0, 0), np.float32)
        weights, trust = [], []
        for bit in self.code.T:
            one, zero = freq[bit > 0].mean(0), freq[bit < 0].mean(0)
            w = np.log(one) - np.log(zero)
            weights.append(w)
            trust.append(((one - zero) * w).sum())
        self.weights = np.array(weights, np.float32).T.reshape(BUCKETS, len(weights)).copy()
        self.trust = np.array(trust, np.float32) / max(sum(trust), 1e-9)

    def decode(self, sums, n):
        """(language index, score, ambiguous) of documents by their summed log-odds over n trigrams."""
        import numpy as np

        margin = sums / np.maximum(n, 1)[:, None] * np.sqrt(np.minimum(np.maximum(n, 1), 400))[:, None]
        loss = (np.logaddexp(0, -margin[:, None, :] * self.code[None]) * self.trust).sum(2)
        best = loss.argmin(1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        score = p[np.arange(len(p)), best]
        rest = np.sort(p, axis=1)
        return best, score, (rest[:, -1] - rest[:, -2] < 0.05) if p.shape[1] > 1 else np.zeros(len(p), bool)


def predict(docs: DataFrame, model: Model, keep=()) -> DataFrame:
    """`keep` columns, lang_pred, score (0 to 1), ambiguous for every row of (.., text), over whole texts.

    A null text, and one without a letter, is `und` with score 0; so is every text if no language was learned.
    """
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", lang_pred string, score double, ambiguous boolean"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in text_batches(batches):
            letters = np.array(batch.column(len(keep)).to_pylist(), dtype=bool)
            raw, offsets = text_buffer(batch.column(len(keep) + 1))
            n_docs, bits = len(letters), model.weights.shape[1]
            sums, n = np.zeros((n_docs, bits), np.float32), np.zeros(n_docs, np.int64)
            h, spans = gram_ids(raw, offsets)
            if len(h):
                n = spans[1] - spans[0]
                for i in np.flatnonzero(n):  # a document's rows of the table, summed at once
                    sums[i] = model.weights[h[spans[0][i] : spans[1][i]]].sum(0)
            names, score, vague = np.full(n_docs, "und", dtype=object), np.zeros(n_docs), np.zeros(n_docs, bool)
            if model.langs:
                best, p, close = model.decode(sums, n)
                names[letters], score[letters], vague[letters] = np.array(model.langs, dtype=object)[best[letters]], p[letters], close[letters]
            out = [*(batch.column(i) for i in range(len(keep))), pa.array(names, pa.string()), pa.array(score.astype(float)), pa.array(vague)]
            yield pa.RecordBatch.from_arrays(out, [*keep, "lang_pred", "score", "ambiguous"])

    text = F.col("text").cast("string")
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return docs.select(*keep, letters.alias("_letters"), text.alias("text")).mapInArrow(run, schema)


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous: learned from rows outside the held-out fold, told for all.

    The fold is crc32 of the id's text modulo `folds`. Null languages teach nothing. Rows are independent once
    the model is fitted, so repeated rows get equal answers; extra columns are never read; an empty table gives
    an empty result. A null id has the fold of the empty text; languages that come equally near go by code point, the
    first one. Texts are summed whole, a slice of rows at a time, so the longest text bounds a task's memory.
    """
    out = docs.select("doc_id", "text", "lang").withColumn("held_out", crc_mod(F.col("doc_id"), folds) == held)
    counts = fit_counts(out.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull())).toPandas()
    return predict(out.select("doc_id", "held_out", "text"), Model(counts), keep=("doc_id", "held_out"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op1_language_id": op1_language_id}
ORACLE: dict[str, str] = {}
