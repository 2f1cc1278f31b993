"""Toxicity by class-conditional Kneser-Ney models of expressions, the beginnings of words.

An expression tells if its class rates differ beyond chance and by RATIO. A word is read as the telling expressions that it begins with, each
longer than the one before: from u, the start of the word or a telling expression, to the next one v, or to none. Class c gives
p_c(v|u) = ex_c(v) / n_c(u) + back_c(u) W(v) / (W(u) + 1) and p_c(none|u) = ex_c(none) / n_c(u) + back_c(u) (W(u) + 1 - sum W(v)) / (W(u) + 1),
with ex_c = max(count_c - DISCOUNT, 0) and back_c(u) = 1 - sum ex_c / n_c(u), the mass that discounts leave, so from any u they sum to 1 in either
class. Counts are of the class's labelled documents with a word that begins so; n_c(u) is u's own count, or the sum over what follows it if
that is more, and at the start of words all different words of the class's documents; count_c(none) is the rest of it. W, the shared backoff
counts, are continuation counts: in how many different words of all documents, labelled or not, an expression is the beginning.
What is rare in a class, or tells nothing, is smoothed by them; letters that belong to no
telling expression are as likely in one class as in the other and are left out.

Expressions tell rare words: one never seen is judged by what it begins with.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, arrow_type, fields, kept_names, looked_up, mixed, stored, table, utf8, with_columns
from .decontamination import words_of

#: Differences of mean log-likelihoods are in proportion below 1 / SCALE and logarithmic beyond.
SCALE = 30
#: At most about so many rows calibrate. Labels are broadcast up to so many; beyond, they join by a shuffle.
CALIBRATE, BROADCAST = 8_000, 1_000_000
#: A model travels in blocks of about so many expressions; each block passes over the documents.
BLOCK = 1_000_000
DISCOUNT = 0.5
#: An expression tells if its rates differ by this factor, and if the likelihood ratio statistic of the difference is beyond this: chance passes it once in 130,000 times.
RATIO, BEYOND = 4, 20
#: Expressions (named by two hashes: with and without their last letter) with their documents by class; without a parent, different words of documents by class.
COUNTS = "parent long, key long, toxic long, ordinary long"
RATED = "toxic_ll double, ordinary_ll double, n_words long"
_END = 32
_LETTERS = np.random.default_rng(20240311).integers(0, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    power = np.full(n, _STEP)
    power[0] = 1
    return np.multiply.accumulate(power)


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each letter of each word (and its end): the letter before (the end, at the start), the letter, the names of the word before it and up to it."""
    letters = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)
    ends = np.flatnonzero(letters == _END)
    n = np.diff(np.concatenate([[-1], ends]))
    place = np.arange(len(letters)) - np.repeat(ends + 1 - n, n)
    value = _LETTERS[letters] * _powers(int(n.max()))[place]
    sums = np.cumsum(value)
    after = sums - np.repeat((sums - value)[ends + 1 - n], n)
    before = np.concatenate([[np.uint8(_END)], letters[:-1]])
    return before, letters, mixed(after - value), mixed(after)


def counted(rows: DataFrame, most: int = 2_000_000) -> DataFrame:
    """COUNTS of rows (text, toxic: true or false), added up within each task first."""
    schema = arrow_type(COUNTS)

    def each(batches):
        held, n, words_of_class = [], 0, [0, 0]

        def out():
            parent, key, toxic = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            _, at, of = np.unique(key, return_index=True, return_inverse=True)
            both, bad = np.bincount(of), np.bincount(of, weights=toxic).astype(np.int64)
            for s in range(0, len(at), 200_000):
                own = slice(s, s + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in (parent[at[own]].view(np.int64), key[at[own]].view(np.int64), bad[own], (both - bad)[own])], schema=schema)

        for batch in batches:
            for text, toxic in zip(utf8(batch, "text"), batch.column(batch.schema.get_field_index("toxic")).to_pylist(), strict=True):
                words = list(set(words_of(text)))
                if not words:
                    continue
                words_of_class[not toxic] += len(words)
                _, _, parent, key = spelled(words)
                key, at = np.unique(key, return_index=True)
                held.append((parent[at], key, np.full(len(key), toxic)))
                n += len(key)
                if n >= most:
                    yield from out()
                    n = 0
        if held:
            yield from out()
        yield pa.RecordBatch.from_arrays([pa.array([x], type=pa.int64()) for x in (None, 0, *words_of_class)], schema=schema)

    sums = [F.sum(x).alias(x) for x in ("toxic", "ordinary")]
    return rows.mapInArrow(each, T.StructType(fields(COUNTS))).groupBy("parent", "key").agg(*sums)


def distinct_words(texts: DataFrame, most: int = 200_000) -> DataFrame:
    """The different words of the column text, made distinct within each task first, so many at a time."""

    def each(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for text in utf8(batch, "text"):
                seen.update(words_of(text))
                if len(seen) >= most:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), type=pa.binary())], names=["word"])
                    seen.clear()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), type=pa.binary())], names=["word"])

    return texts.select("text").mapInArrow(each, "word binary").distinct()


def telling(totals: tuple[int, int]) -> Column:
    """Whether the class rates of an expression (toxic, ordinary: its documents; totals: all documents) differ beyond chance (by a likelihood ratio test) and by RATIO."""
    t, o = max(totals[0], 1), max(totals[1], 1)
    n, share = F.col("toxic") + F.col("ordinary"), t / (t + o)
    seen = lambda x, expected: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / expected)).otherwise(0.0)
    off = 2 * (seen("toxic", n * share) + seen("ordinary", n * (1 - share))) > BEYOND
    rate = ((F.col("toxic") + 0.5) / t) / ((F.col("ordinary") + 0.5) / o)
    return (F.greatest("toxic", "ordinary") > DISCOUNT) & off & ((rate > RATIO) | (rate < 1 / RATIO))


HITS = "word long, place int, key long"


def telling_beginnings(words: DataFrame, keys: DataFrame, block: int) -> DataFrame:
    """(key, up, stem, types) of telling expressions: the telling one before it (null at the start of words), the first one, and how many different words begin so.

    Keys travel in blocks; what a word hits in each is put in order by a shuffle of the hits.
    """
    schema, blocks, hits = arrow_type(HITS), max(1, -(-keys.count() // block)), None
    for b in range(blocks):
        own = np.sort(keys.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).toPandas()["key"].to_numpy(dtype=np.int64).view(np.uint64))
        shared = words.sparkSession.sparkContext.broadcast(own)

        def each(batches, shared=shared):
            own = shared.value
            for batch in batches:
                for i in range(0, batch.num_rows if len(own) else 0, 20_000):
                    _, letters, _, key = spelled(batch.column(0).slice(i, 20_000).to_pylist())
                    begins = starts_of(letters)
                    hit = np.flatnonzero(own[np.minimum(np.searchsorted(own, key), len(own) - 1)] == key)
                    word = np.searchsorted(begins, hit, side="right") - 1
                    whole = key[np.append(begins[1:], len(letters)) - 1]  # a word's name is that of all its letters and its end
                    yield pa.RecordBatch.from_arrays([pa.array(whole[word].view(np.int64)), pa.array((hit - begins[word]).astype(np.int32)), pa.array(key[hit].view(np.int64))], schema=schema)

        found = stored(words.mapInArrow(each, T.StructType(fields(HITS))), "hits")
        shared.destroy()
        hits = found if hits is None else hits.unionByName(found)
    ways = hits.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("place", "key"))).alias("way"))
    steps = ways.select("way", F.posexplode("way").alias("i", "x")).select(F.col("x.key").alias("key"), F.when(F.col("i") > 0, F.col("way")[F.col("i") - 1]["key"]).alias("up"), F.col("way")[0]["key"].alias("stem"))
    return steps.groupBy("key").agg(F.first("up").alias("up"), F.first("stem").alias("stem"), F.count("*").alias("types"))


def starts_of(letters: np.ndarray) -> np.ndarray:
    """Where each word begins."""
    return np.concatenate([[0], np.flatnonzero(letters == _END)[:-1] + 1])


class Model:
    """A block of the models of both classes: some stems and all that tells after them. none: log-chances of no telling expression, by class."""

    def __init__(self, rows, none: np.ndarray):
        key = rows["key"].to_numpy(dtype=np.int64).view(np.uint64)
        order = np.argsort(key)
        self.keys, self.none = key[order], none
        self.step, self.end = (np.stack([rows[f"{x}_{c}"].to_numpy(dtype=float)[order] for c in ("toxic", "ordinary")]) for x in ("step", "end"))

    def scores(self, words: list[bytes], shared: bool) -> np.ndarray:
        """Log-likelihoods of words in both classes (2 rows). Unless `shared`, only what this block adds to those of words that begin with nothing telling."""
        out = np.repeat(self.none[:, None], len(words), axis=1) if shared else np.zeros((2, len(words)))
        if len(self.keys):
            _, letters, _, key = spelled(words)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == key)
            word = np.searchsorted(starts_of(letters), hit, side="right") - 1
            last = np.flatnonzero(np.append(word[1:] != word[:-1], True)) if len(hit) else hit
            for c in range(2):
                out[c] += np.bincount(word, weights=self.step[c, at[hit]], minlength=len(words))
                out[c, word[last]] += self.end[c, at[hit[last]]] - self.none[c]
        return out


class Trained:
    """Both models as a stored table, of which a block at a time comes to the driver: key, stem, and log-chances by class of the step to it and of the end after it."""

    def __init__(self, rows: DataFrame, none: np.ndarray, block: int):
        self.rows, self.none, self.blocks = rows, none, max(1, -(-rows.count() // block))

    def block(self, b: int) -> Model:
        return Model(self.rows.where(F.pmod(F.xxhash64("stem"), F.lit(self.blocks)) == b).toPandas(), self.none)


def train(rows: DataFrame, block: int = BLOCK) -> Trained:
    """The models of rows (text, toxic or null): class counts from rows with a label, continuation counts from the words of all."""
    labelled = rows.where("toxic is not null and text is not null")
    counts = stored(counted(labelled), "counts")
    totals = tuple(labelled.agg(F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0)), F.coalesce(F.sum((~F.col("toxic")).cast("long")), F.lit(0))).first())
    n = counts.where("parent is null").agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in ("toxic", "ordinary"))).first()
    ones = stored(counts.where(F.col("parent").isNotNull() & telling(totals)).select("key", "toxic", "ordinary"), "telling")
    words = stored(distinct_words(rows), "words")
    own = stored(ones.join(telling_beginnings(words, ones.select("key"), block), "key"), "expressions")

    less = lambda x: F.greatest(F.col(x) - DISCOUNT, F.lit(0))
    sums = own.groupBy(F.col("up").alias("at")).agg(*(F.sum(x).alias(f"sum_{x}") for x in ("toxic", "ordinary", "types")), *(F.sum(less(x)).alias(f"used_{x}") for x in ("toxic", "ordinary")))
    start = sums.where("at is null").select(F.lit(None).cast("long").alias("at"), *(F.greatest(F.lit(float(n[i])), F.lit(1.0)).alias(f"n_{x}") for i, x in enumerate(("toxic", "ordinary"))), F.lit(float(words.count())).alias("n_types"), "sum_types", "used_toxic", "used_ordinary", "sum_toxic", "sum_ordinary")
    inner = own.join(sums.where("at is not null"), F.col("key") == F.col("at"), "left").select(F.col("key").alias("at"), *(F.greatest(F.col(x), F.coalesce(f"sum_{x}", F.lit(0)), F.lit(1)).cast("double").alias(f"n_{x}") for x in ("toxic", "ordinary")), F.col("types").cast("double").alias("n_types"), *(F.coalesce(x, F.lit(0)).alias(x) for x in ("sum_types", "used_toxic", "used_ordinary", "sum_toxic", "sum_ordinary")))
    ends = {x: F.greatest(F.col(f"n_{x}") - F.col(f"sum_{x}") - DISCOUNT, F.lit(0)) for x in ("toxic", "ordinary")}
    back = {x: 1 - (F.col(f"used_{x}") + ends[x]) / F.col(f"n_{x}") for x in ends}
    none = (F.col("n_types") + 1 - F.col("sum_types")) / (F.col("n_types") + 1)
    ups = stored(start.unionByName(inner).select("at", "n_toxic", "n_ordinary", "n_types", *(b.alias(f"back_{x}") for x, b in back.items()), *(F.log(ends[x] / F.col(f"n_{x}") + F.greatest(b, F.lit(1e-9)) * none).alias(f"end_{x}") for x, b in back.items())), "ups")
    step = [F.log(F.greatest(less(x) / F.col(f"n_{x}") + F.greatest(F.col(f"back_{x}"), F.lit(1e-9)) * F.col("types") / (F.col("n_types") + 1), F.lit(1e-300))).alias(f"step_{x}") for x in ("toxic", "ordinary")]
    steps = looked_up(own.select("key", "up", "stem", "types", "toxic", "ordinary").withColumn("from", F.coalesce("up", F.lit(0))).withColumn("root", F.col("up").isNull()), ups.where("at is not null"), "up", "at").join(F.broadcast(ups.where("at is null").select(*(F.col(x).alias(f"r_{x}") for x in ("n_toxic", "n_ordinary", "n_types", "back_toxic", "back_ordinary")))), F.lit(True), "left")
    steps = steps.withColumns({x: F.when(F.col("root"), F.col(f"r_{x}")).otherwise(F.col(x)) for x in ("n_toxic", "n_ordinary", "n_types", "back_toxic", "back_ordinary")}).select("key", "stem", *step)
    out = stored(steps.join(ups.where("at is not null").select(F.col("at").alias("key"), "end_toxic", "end_ordinary"), "key"), "steps")
    first = ups.where("at is null").select("end_toxic", "end_ordinary").first()
    return Trained(out, np.zeros(2) if first is None else np.array(first, dtype=float), block)


class WordScores:
    """Log-likelihoods of words in a block, remembered for at most about `most` distinct words at a time."""

    def __init__(self, model: Model, shared: bool, most: int = 400_000):
        self.model, self.shared, self.most, self.seen = model, shared, most, {}
        self.values = np.zeros((2, 1 << 16))

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """A column per word, a row per class."""
        seen = self.seen
        try:
            at = np.fromiter(map(seen.__getitem__, words), dtype=np.int64, count=len(words))
        except KeyError:
            if len(seen) > self.most:
                seen.clear()
            new = [w for w in set(words) if w not in seen]
            n = len(seen) + len(new)
            if n > self.values.shape[1]:
                self.values = np.concatenate([self.values, np.zeros((2, n))], axis=1)
            self.values[:, len(seen) : n] = self.model.scores(new, self.shared)
            seen.update(zip(new, range(len(seen), n), strict=True))
            at = np.fromiter(map(seen.__getitem__, words), dtype=np.int64, count=len(words))
        return self.values[:, at]

    def means(self, texts: list[bytes | None], together: int = 100_000) -> tuple[np.ndarray, list[int]]:
        """Mean log-likelihoods (a row per text, a column per class) and words of texts; short ones are looked up together."""
        out, sizes, held, lengths = [np.zeros((2, 0))], [], [], []

        def flush():
            of, values = np.repeat(np.arange(len(lengths)), lengths), self(held)
            out.append(np.stack([np.bincount(of, weights=v, minlength=len(lengths)) for v in values]) / np.maximum(lengths, 1))
            sizes.extend(lengths)
            held.clear()
            lengths.clear()

        for text in texts:
            own = words_of(text)
            held.extend(own)
            lengths.append(len(own))
            if len(held) >= together:
                flush()
        if lengths:
            flush()
        return np.concatenate(out, axis=1).T, sizes


def rated(docs: DataFrame, trained: Trained, text_col: str = "text") -> DataFrame:
    """docs plus toxic_ll, ordinary_ll (mean log-likelihoods of the whole text's words; 0 without words) and n_words.

    Each block of the models is a pass over docs; all but the last are stored, so that only one block is on the driver and the executors.
    """
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    for b in range(trained.blocks):
        shared = docs.sparkSession.sparkContext.broadcast(trained.block(b))
        docs = _pass(docs, shared, text_col, b == 0)
        if b + 1 < trained.blocks:
            docs = stored(docs, "rated")
            shared.destroy()
    return docs


def _pass(docs: DataFrame, shared, text_col: str, first: bool) -> DataFrame:
    kept, schema = kept_names(docs, RATED), arrow_type(RATED)

    def each(batches):
        scores = WordScores(shared.value, first)
        for batch in batches:
            lls, n = scores.means(utf8(batch, text_col))
            if not first:
                lls += np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("toxic_ll", "ordinary_ll")])
            yield with_columns(batch, kept, schema, [pa.array(lls[:, 0]), pa.array(lls[:, 1]), pa.array(n, type=pa.int64())])

    return arrow_map(docs, RATED, each)


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; ids without text are in no fold."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5


def calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve by Newton steps with a small ridge."""
    x = np.column_stack([x, np.ones(len(x))]) if len(x) else np.zeros((0, 2))
    w, ridge = np.zeros(2), 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), x.T @ (y - p) - ridge * w)
    return float(w[0]), float(w[1])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", calibrate: int = CALIBRATE, **options) -> DataFrame:
    """docs plus toxic_ll, ordinary_ll, n_words, held_out, score and predicted.

    The score is a logistic curve over asinh(SCALE * x), x being what toxic_ll - ordinary_ll exceeds that of words that tell nothing by. Labels teach only in folds 1 to 4: all of folds 1 to 3
    give the models' class counts, fold 4 about `calibrate` rows (chosen by a hash) for the curve. Continuation counts
    are of the texts of all of docs. Null labels and ids teach nothing; of several labels of an id the smallest
    counts. Texts without words, null and empty ones too, get the share of toxic rows among those of the curve. Words and texts may be of any length.
    With no usable labels every score is 0.5 or less by the prior seen. Repeated rows score alike. Input columns with
    the names of results are replaced. An empty table gives no rows.
    """
    lab = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__id is not null and __y in (0, 1)").groupBy("__id").agg(F.min("__y").alias("__y"))
    lab = lab.withColumn("__fold", fold(F.col("__id"))).where("__fold <> 0")
    n = {r[0]: r[1] for r in lab.groupBy(F.col("__fold") < 4).agg(F.count("*")).collect()}
    chosen = F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, calibrate / max(n.get(False, 0), 1))))
    few = sum(n.values()) <= BROADCAST
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    mine, hint = F.col("id") == F.col("__id"), F.broadcast if few else (lambda x: x)
    models = train(texts.join(hint(lab.where("__fold < 4")), mine, "left").select("text", (F.col("__y") == 1).alias("toxic")), **options)
    seen = rated(texts.join(hint(lab.where(chosen & (F.col("__fold") == 4))), mine).select("text", "__y"), models)
    seen = seen.select(F.col("toxic_ll") - F.col("ordinary_ll"), "__y").toPandas().to_numpy(dtype=float)
    slope, intercept = calibrated(np.arcsinh(SCALE * (seen[:, 0] - models.none[0] + models.none[1])), seen[:, 1])
    out = rated(docs.drop("held_out", "score", "predicted"), models, text_col)
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), slope * F.asinh(SCALE * (F.col("toxic_ll") - F.col("ordinary_ll") - float(models.none[0] - models.none[1]))) + intercept))
    prior = (seen[:, 1].sum() + 0.5) / (len(seen) + 1)
    z = F.when(F.col("n_words") > 0, z).otherwise(float(np.log(prior / (1 - prior))))
    out = out.withColumn("held_out", F.coalesce(fold(F.col(id_col)) == 0, F.lit(False))).withColumn("score", 1 / (1 + F.exp(-z)))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", (F.col("predicted") == 1).alias("is_toxic"), "toxic_ll", "ordinary_ll")
