"""Brown class-based bigram model: exchange clustering of words, class transitions, word emissions, perplexity.

Exchange: a word moves to the class in which the log likelihood of the corpus under class bigrams rises most, given
its counts of neighbouring classes and the table of class pairs. Here each task moves its words one small lot after the
other, keeping its own copy of the table up to date, and tasks learn of each other's moves after the step (half of
the words a step, fewer after a step that failed); a step stays only if the exact objective rose. What moves is a
unit: each of the OWN most frequent words by itself, all other and unknown words together by their last letters. So
a model has UNITS units whatever the corpus, and its arrays by unit are what the driver holds and tasks are given;
words, their counts and the counts of neighbours are of all training rows and stay tables.

A text's probability is that of its classes, each given the one before, times that of each word given its class.
Both are discounted; the emissions' discount is the class's probability of an unknown word, which like in the base
model is one event whatever its spelling.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import BLOCK, block_ids, look_up, pack, unpack
from .common import crc_mod, cut, drop, table, text_batches, tidy

CLASSES = 64
STEPS = 5  # of the exchange, at most
OWN = 1 << 15  # words that move by themselves, at most: the size of the model, like the number of classes
TAILS = 1 << 13  # groups of the other words, by a hash of their last letters
LETTERS = 3
UNITS = 1 + OWN + TAILS
END = "\n"  # the end of a text; no word holds white space
HELD_BACK = 0.5  # discount of class pairs
ROWS = 1 << 11  # counts that are compared with all classes at once
PLACE = 18  # bits of a neighbour's side and unit within a count
PAIRS = 1 << 21  # distinct pairs of units that a task sums up before it sends them on


def token_blocks(docs: DataFrame, held: Column) -> DataFrame:
    """block, ids, held, sizes (words by document), words, train (training occurrences of each), packed (places of words, units
    of the words' last letters)."""
    kind = dict(docs.dtypes)["doc_id"]

    def write(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        number = block_ids()
        for batch in text_batches(batches, BLOCK):
            place: dict[bytes, int] = {END.encode(): 0}
            codes, sizes = [], []
            for text in batch.column(2).to_pylist():
                words = text.encode().lower().split() if text else []
                codes += [place.setdefault(w, len(place)) for w in words]
                sizes.append(len(words))
            codes, sizes, out = np.array(codes, np.int64), np.array(sizes, np.int64), np.asarray(batch.column(1).to_pylist(), bool)
            train = np.bincount(codes[np.repeat(~out, sizes)], minlength=len(place))
            train[0] += (~out).sum()
            words = [w.decode() for w in place]
            tails = np.array([1 + OWN + zlib.crc32(w[-LETTERS:].encode()) % TAILS for w in words], np.int64)
            values = [[next(number)], [batch.column(0).to_pylist()], [out], [sizes], [words], [train], [pack(codes, tails)]]
            types = [pa.int64(), pa.list_(batch.column(0).type), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names)

    names = ["block", "ids", "held", "sizes", "words", "train", "packed"]
    schema = f"block bigint, ids array<{kind}>, held array<boolean>, sizes array<bigint>, words array<string>, train array<bigint>, packed binary"
    return docs.select("doc_id", held.alias("held"), F.col("text").cast("string").alias("text")).mapInArrow(write, schema)


def sequences(sizes, codes):
    """All documents' codes, each document between ends (code 0), and where each document's first word stands."""
    import numpy as np

    out = np.zeros(len(codes) + 2 * len(sizes), np.int64)
    first = np.cumsum(sizes + 2) - sizes - 1
    at = np.arange(len(codes)) + np.repeat(2 * np.arange(len(sizes)) + 1, sizes)
    out[at] = codes
    return out, first


def read_block(batch, row: int):
    """sizes, places of words, units of tails, and what each of a block's words is: an own unit's negative number, or its count."""
    import numpy as np

    sizes, value = (np.asarray(batch.column(c).slice(row, 1).flatten()) for c in ("sizes", "found"))
    codes, tails = unpack(batch.column("packed")[row].as_py())
    return sizes, codes, tails, value


def units_of(value, tails):
    """Units of a block's words, by what they were told as: an own unit's negative number, or a count."""
    import numpy as np

    out = np.where(value < 0, -value, tails)
    out[0] = 0
    return out


def bigrams(coded: DataFrame) -> DataFrame:
    """(pair, n): neighbouring units a * 2^17 + b of all training documents, whose first word follows an end."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        held_pairs, held_n = [], []

        def merged():
            pairs, at = np.unique(np.concatenate(held_pairs), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate(held_n)).astype(np.int64)
            held_pairs.clear(), held_n.clear()
            return pairs, n

        def sent(pairs, n):
            for i in range(0, len(pairs), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[i : i + (1 << 17)]), pa.array(n[i : i + (1 << 17)])], ["pair", "n"])

        for batch in batches:
            for row in range(batch.num_rows):
                sizes, codes, tails, value = read_block(batch, row)
                held = batch.column("held").slice(row, 1).flatten().to_numpy(zero_copy_only=False)
                words, first = sequences(sizes, codes)
                units = units_of(value, tails)[words]
                inside = np.repeat(~held.astype(bool), sizes + 2)
                inside[first - 1] = False  # no pair ends where a document begins
                at = np.flatnonzero(inside)
                pairs, n = np.unique((units[at - 1] << 17) | units[at], return_counts=True)
                held_pairs.append(pairs)
                held_n.append(n)
                if sum(map(len, held_pairs)) > PAIRS:
                    pairs, n = merged()
                    if len(pairs) > PAIRS // 2:
                        yield from sent(pairs, n)
                    else:
                        held_pairs.append(pairs)
                        held_n.append(n)
        if held_pairs:
            yield from sent(*merged())

    return coded.select("sizes", "held", "found", "packed").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def neighbours(pairs: DataFrame) -> DataFrame:
    """(unit, seen): one row for each unit; of its neighbours, n * 2^18 + side * 2^17 + unit: what follows it, and, of side 1, what precedes."""
    a, b = F.shiftright("pair", 17), F.col("pair").bitwiseAND((1 << 17) - 1)
    entry = lambda unit, other, side: F.struct(unit.cast("int").alias("unit"), (F.shiftleft("n", PLACE) + (side << 17) + other).alias("x"))
    return pairs.select(F.inline(F.array(entry(a, b, 0), entry(b, a, 1)))).groupBy("unit").agg(F.collect_list("x").alias("seen"))


def read_seen(batch):
    """units, where their counts start, and of each count: side, unit, n."""
    import numpy as np

    lists = batch.column("seen")
    x, offsets = np.asarray(lists.flatten()), np.asarray(lists.offsets).astype(np.int64)
    return np.asarray(batch.column("unit")).astype(np.int64), offsets - offsets[0], (x >> 17) & 1, x & ((1 << 17) - 1), x >> PLACE


def first_classes(seen: DataFrame, sizes, k: int):
    """A class for each unit: the end has class 0, the k most frequent units one each, others the one of them that is most their neighbour."""
    import numpy as np

    root = np.sqrt(np.maximum(sizes[: k + 1], 1))

    def near(batches):
        import pyarrow as pa

        for batch in batches:
            units, bounds, _, other, n = read_seen(batch)
            best = np.zeros(len(units), np.int32)
            for i in range(len(units)):
                part = slice(bounds[i], bounds[i + 1])
                seeds = (other[part] > 0) & (other[part] <= k)
                if seeds.any():
                    best[i] = np.bincount(other[part][seeds], weights=n[part][seeds] / root[other[part][seeds]]).argmax()
            yield pa.RecordBatch.from_arrays([batch.column("unit"), pa.array(best)], ["unit", "cls"])

    out = np.arange(len(sizes)) % k + 1
    found = seen.mapInArrow(near, "unit int, cls int").where("cls > 0").toArrow()  # a row for each unit at most
    out[np.asarray(found.column("unit"))] = np.asarray(found.column("cls"))
    out[: k + 1] = np.arange(k + 1)
    return out


def class_pairs(seen: DataFrame, classes, k: int):
    """The table of class pairs (a class, the class that follows); each task sums up its own (k + 1)^2 numbers."""
    import numpy as np

    def count(batches):
        import pyarrow as pa

        out = np.zeros((k + 1) ** 2)
        for batch in batches:
            units, bounds, side, other, n = read_seen(batch)
            of = np.repeat(classes[units], np.diff(bounds))
            out += np.bincount((of * (k + 1) + classes[other])[side == 0], weights=n[side == 0], minlength=len(out))
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["at", "n"])

    table = np.zeros((k + 1) ** 2)
    for r in seen.mapInArrow(count, "at bigint, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():
        table[r["at"]] = r["n"]
    return table.reshape(k + 1, k + 1)


def objective(pairs) -> float:
    import numpy as np

    g = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return g(pairs) - g(pairs.sum(1)) - g(pairs.sum(0))


def gains(own, starts, side, cls, n, pairs):
    """Units x classes: what each unit adds to the objective in each class, beside what is there without it.

    Unit i, now in class own[i], has the counts from starts[i] on: n times class cls on that side. How a unit's own
    leaving changes its row in other classes (one cell of each) is left out; objective() has the last word on a step.
    """
    import numpy as np

    g = lambda x: x * np.log(np.maximum(x, 1))
    of = np.repeat(np.arange(len(own)), np.diff(np.append(starts, len(n))))
    base = np.where((side == 0)[:, None], pairs.T[cls], pairs[cls])  # by count: class k before, or after, cls
    at = np.arange(len(n)), own[of]
    base[at] = np.maximum(base[at] - n, 0)
    out = np.add.reduceat(g(base + n[:, None]) - g(base), starts, axis=0)
    total = np.add.reduceat(np.where(side == 0, n, 0), starts)
    sizes = np.repeat(pairs.sum(1)[None], len(own), axis=0)
    rows = np.arange(len(own)), own
    sizes[rows] = np.maximum(sizes[rows] - total, 0)
    return out - 2 * (g(sizes + total[:, None]) - g(sizes))


def exchanged(seen: DataFrame, classes, pairs, step: int, parts: int):
    """Classes after one step: one of `parts` of the units, another each step, go where they gain most; the end stays."""
    import numpy as np

    k = len(pairs)

    def move(batches):
        import pyarrow as pa

        now = pairs.copy()
        for batch in batches:
            units, bounds, side, other, n = read_seen(batch)
            own = classes[units]
            new, of = own.copy(), np.repeat(np.arange(len(units)), np.diff(bounds))
            turn = (units != 0) & ((units ^ (units >> 5) ^ (units >> 10)) % parts == step % parts)
            # counts by neighbouring class: one number for each side and class
            cell, at = np.unique((of * 2 + side) * k + classes[other], return_inverse=True)
            n = np.bincount(at, weights=n)
            of, side, cls = cell // (2 * k), cell // k % 2, cell % k
            bounds, i = np.searchsorted(of, np.arange(len(units) + 1)), 0
            while i < len(units):
                j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + ROWS, "right")) - 1)
                part = slice(bounds[i], bounds[j])
                gain = gains(own[i:j], bounds[i:j] - bounds[i], side[part], cls[part], n[part], now)
                gain[:, 0] = -np.inf
                new[i:j] = np.where(turn[i:j], gain.argmax(1), own[i:j])
                for x, sign in ((own, -1), (new, 1)):  # the lot's counts leave the old rows and columns for the new ones
                    before, after = (np.where(side[part] == s, x[of[part]], cls[part]) for s in (0, 1))
                    np.add.at(now, (before, after), sign * n[part])
                np.maximum(now, 0, out=now)
                i = j
            moved = new != own
            yield pa.RecordBatch.from_arrays([pa.array(units[moved].astype(np.int32)), pa.array(new[moved].astype(np.int32))], ["unit", "cls"])

    out, found = classes.copy(), seen.mapInArrow(move, "unit int, cls int").toArrow()  # a row for each unit at most
    out[np.asarray(found.column("unit"))] = np.asarray(found.column("cls"))
    return out


def exchange(seen: DataFrame, sizes, k: int, steps: int):
    """Classes by unit, the table of class pairs, and the objective at the start and after each step that was kept.

    After a step that lowered the objective, its units are where they were and fewer go at once.
    """
    best, parts = first_classes(seen, sizes, k), 2
    pairs = class_pairs(seen, best, k)
    heights = [objective(pairs)]
    for step in range(steps):
        classes = exchanged(seen, best, pairs, step, parts)
        now = class_pairs(seen, classes, k)
        if objective(now) > heights[-1]:
            best, pairs = classes, now
            heights.append(objective(now))
        else:
            parts *= 2
    return best, pairs, heights


@dataclass
class Model:
    """classes by unit; own: counts of the words that are units; transitions[c, d] = log10 p(d | c); sizes, known: tokens
    and distinct words by class; words: (key, n, unit) of all training words, a table."""

    words: DataFrame
    classes: object
    own: object
    transitions: object
    sizes: object
    known: object
    discount: float
    tokens: int
    types: int
    heights: list

    def unknown(self):
        """log10 of the probability of an unknown word by class; -inf for the end's and for empty classes."""
        import numpy as np

        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.log10(np.where(self.sizes > 0, self.discount * self.known / np.maximum(self.sizes, 1), 0))
        out[0] = -np.inf
        return out

    def word_classes(self) -> DataFrame:
        """(word, n, cls) of all training words."""
        classes = [int(c) for c in self.classes]
        of = F.broadcast(self.words.sparkSession.createDataFrame(list(enumerate(classes)), "unit int, cls int"))  # UNITS rows
        return self.words.join(of, "unit").select(F.col("key").alias("word"), "n", "cls")


def transition_logs(pairs):
    """log10 p(d | c): counts less a discount, which goes to classes by how many tokens they have."""
    import numpy as np

    k, sizes = len(pairs), pairs.sum(1)
    prior = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * k)
    rest = np.where(sizes > 0, HELD_BACK * (pairs > 0).sum(1) / np.maximum(sizes, 1), 1.0)
    return np.log10(np.maximum(pairs - HELD_BACK, 0) / np.maximum(sizes, 1)[:, None] + rest[:, None] * prior)


def learn(coded: DataFrame, words: DataFrame, k: int = CLASSES, steps: int = STEPS) -> Model:
    """The model of the blocks' training documents; `words` (key, n, unit) are their counts, the end included."""
    import numpy as np

    s = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two")).first()
    sizes, types = np.zeros(UNITS, np.int64), np.zeros(UNITS)
    for r in words.groupBy("unit").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():  # UNITS rows at most
        sizes[r["unit"]], types[r["unit"]] = r["n"], r["types"]
    seen = cut(neighbours(bigrams(coded)), "lm-neighbours")
    classes, pairs, heights = exchange(seen, sizes, k, steps)
    drop(seen)
    discount = min(0.9, max(0.1, s["one"] / (s["one"] + 2 * s["two"]))) if s["one"] else 0.1
    return Model(words, classes, sizes[: 1 + OWN], transition_logs(pairs), pairs.sum(1), np.bincount(classes, weights=types, minlength=k + 1), discount, s["n"], s["v"], heights)


def told(coded: DataFrame, model: Model) -> DataFrame:
    """Scores of the blocks' documents."""
    import numpy as np

    unknown, moves, sizes, less, n_all, n_types = model.unknown(), model.transitions, model.sizes, model.discount, model.tokens, model.types
    other = int(np.argmax(model.known * (np.arange(len(sizes)) > 0)))  # the class of words whose last letters no training word has
    if not np.isfinite(unknown[other]):
        unknown[other] = np.log10(less)  # nothing but ends was seen
    classes, own = np.where(np.isfinite(unknown)[model.classes], model.classes, other), model.own
    kind = dict(coded.dtypes)["ids"][6:-1]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                at = {c: batch.column(c).slice(row, 1).flatten() for c in ("ids", "held")}
                size, codes, tails, value = read_block(batch, row)
                n = np.where(value < 0, own[np.maximum(-value, 0)], value).astype(float)
                n[0] = own[0]
                cls = classes[units_of(value, tails)]
                base = np.log10((n + 0.5) / (n_all + 0.5 * (n_types + 1)))
                given = np.where(n > 0, np.log10(np.maximum(n - less, 1e-9) / np.maximum(sizes[cls], 1)), unknown[cls])
                given[0], cls[0] = 0.0, 0
                words, first = sequences(size, codes)
                c = cls[words]
                each = given[words]
                each[1:] += moves[c[:-1], c[1:]]
                # a document's words and its end stand from its first place on; the ends before it aren't counted
                some = np.ones(len(words), bool)
                some[first - 1] = False
                of = np.repeat(np.arange(len(size)), size + 1)
                sums = [np.bincount(of, weights=x[some], minlength=len(size)) for x in (base[words], each, (n > 0)[words])]
                if not n_all:
                    sums[0][:], sums[1][:] = 0.0, 0.0  # nothing was learned: every token is the unknown one
                out = [at["ids"], at["held"], pa.array(size + 1), pa.array(sums[2].astype(np.int64)), pa.array(np.full(len(size), n_all)), pa.array(sums[0]), pa.array(sums[1]), pa.array(10 ** (-sums[1] / (size + 1)))]
                yield pa.RecordBatch.from_arrays(out, names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    return coded.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")


def with_units(words: DataFrame) -> DataFrame:
    """(key, n, unit) of training words (key, n).

    The own units are the words above a count, on a scale of 64 steps for each doubling, above which there are OWN at
    most; they are numbered from 1 by falling count. The end is 0.
    """
    words = words.withColumn("step", F.floor(F.log2("n") * 64).cast("int"))
    upto, least = 0, 1 << 30
    for r in words.where(F.col("key") != END).groupBy("step").count().orderBy(F.desc("step")).collect():  # 64 rows a doubling
        upto += r["count"]
        if upto > OWN:
            break
        least = r["step"]
    own = words.where((F.col("step") >= least) & (F.col("key") != END))  # OWN rows at most
    own = own.select("key", F.row_number().over(Window.orderBy(F.desc("n"), "key")).alias("own"))
    tail = 1 + OWN + F.crc32(F.right("key", F.lit(LETTERS)).cast("binary")) % TAILS
    return words.join(F.broadcast(own), "key", "left").select("key", "n", F.when(F.col("key") == END, 0).otherwise(F.coalesce("own", tail)).cast("int").alias("unit"))


def prepared(docs: DataFrame, held: Column) -> tuple[DataFrame, DataFrame]:
    """Coded blocks with the words' counts or units, and (key, n, unit) of all training tokens, both written."""
    blocks = cut(token_blocks(docs, held), "lm-blocks")
    pairs = blocks.select(F.inline(F.arrays_zip("words", "train"))).where("train > 0")
    counts = cut(pairs.groupBy(F.col("words").alias("key")).agg(F.sum("train").alias("n")), "lm-counts")
    words = cut(with_units(counts), "lm-words")
    value = F.when(F.col("unit").between(1, OWN), -F.col("unit").cast("long")).otherwise(F.coalesce("n", F.lit(0)))
    coded = cut(look_up(blocks.drop("train"), "words", words, value), "lm-coded")
    drop(blocks, counts)
    return coded, words


def score(docs: DataFrame, folds: int = 5, out: int = 1, classes: int = CLASSES, steps: int = STEPS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity: one row per document.

    Learns from documents whose crc32(doc_id as text) mod `folds` is not `out`; scores (log10) all whole texts, and
    perplexity is 10^(-score / n_tokens). A null or empty text is its end alone. Repeated rows count again, a null id
    has the fold of the empty text. An empty table gives an empty result; without training rows every token is
    unknown and every score 0, the base's included. Only doc_id and text are read. A document longer than a block is
    a block of its own, in the memory of one task.
    """
    with tidy(docs.sparkSession):
        coded, words = prepared(docs, crc_mod(F.col("doc_id"), folds) == out)
        model = learn(coded, words, classes, steps)
    return told(coded, model)


def op11_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op11_class_lm": op11_class_lm}
ORACLE: dict[str, str] = {}
