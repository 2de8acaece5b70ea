"""Language-model scoring by masked pseudo-likelihood.

Every word is predicted from the two words on either side of it by a small network
(numpy, trained here). The network predicts the word's class; the word within its class
comes from counts over all documents, for every word of the corpus. The commonest words
(the head) have classes learned from the words beside them; all others are classed by
length, and their counts are joined by word. A document's score is the sum of the
log-probabilities of all its words.

Word counts are exact and cover the whole corpus. One network learns from all words: the
texts fall into ROUNDS slices by their hash, and in each round the gradients of one slice
are summed over all tasks before the weights move, so neither files nor partitions matter
but for rounding. What the driver holds has a fixed size: the head, the network, the classes' sums and the
counts of the COMMON words that follow the head, which tasks look up; the counts of all others stay in a table, which is joined.
The coded texts are kept in files by slice while a query trains and scores, so that a round reads its own slice alone.

Defined results: a null or empty text has no words and scores 0, its mean is null; a word
at the edge of a text sees an edge class; rows with equal doc_id are scored each by its
own text; all count for training; an empty table gives an empty table; other columns are
neither read nor returned.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from predio.llm.common import checkpointed
from predio.session import shared_folder

#: Words of the head, whose classes are learned, and the longest of these in bytes.
VOCABULARY, LONGEST = 8000, 64
#: At most so many words, the head included, have their counts in every task; the counts of the others are joined.
COMMON = 100_000
#: Steps of counts to a doubling: the head's words are sought from the step on in which its last one lies.
STEPS = 16
#: Classes: the edge, eight of other words by length, the commonest words alone, the rest by weight.
CLASSES, OTHER, ALONE = 64, 8, 24
HIDDEN, WINDOW = 16, 2
#: Groups of classes that are told apart on each side when classes are learned, and rounds of that.
BESIDE, MOVES = 16, 10
BATCH, RATE, SEED = 4096, 0.2, 5  # words that go through the network together
#: A class's value before softmax up to which its exponential is safe in float32.
REACH = 60
#: Slices of the texts, and training steps: each takes a whole slice.
ROUNDS = 32
#: Words counted in a task before it hands its counts on.
FLUSH = 300_000
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words_of(text: str | None) -> list[bytes]:
    """Words as bytes, A-Z in lower case. bytes.split() parts at the same six characters."""
    return (text or "").encode().translate(LOWER).split()


def word_counts(docs: DataFrame) -> DataFrame:
    """word binary, n: over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])
        for batch in batches:
            for text in batch.column(0):
                held.update(words_of(text.as_py()))
                if len(held) > FLUSH:
                    yield give()
                    held.clear()
        yield give()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The head's words, the classes and the log-probability of a word within its class."""

    def __init__(self, words: list[tuple[bytes, int]], others: np.ndarray, counts: DataFrame | None = None, common: list[tuple[bytes, int]] = ()):
        """words: the head with counts, commonest first; others: occurrences of all other
        words in each of their classes; counts: the table of all words, on the driver only;
        common: words outside the head whose counts are held here."""
        self.index = {w: i for i, (w, _) in enumerate(words)}
        self.n, self.others, self.counts = np.array([k for _, k in words], np.float64), others, counts
        n = self.n
        classes = np.zeros(len(n) + OTHER, np.int64)
        classes[: min(ALONE, len(n))] = 1 + OTHER + np.arange(min(ALONE, len(n)))
        rest = n[ALONE:]
        if len(rest):
            share = (np.cumsum(rest) - rest / 2) / rest.sum()
            classes[ALONE : len(n)] = 1 + OTHER + ALONE + np.minimum((share * (CLASSES - 1 - OTHER - ALONE)).astype(np.int64), CLASSES - 2 - OTHER - ALONE)
        classes[len(n) :] = 1 + np.arange(OTHER)
        self.sort_into(classes)
        # a word's place -> its code and the logarithm of its count (of the head's words nothing is added); the last entry: not held
        self.place = self.index | {w: len(n) + i for i, (w, _) in enumerate(common)}
        self.code = np.array([*range(len(n)), *(len(n) + min(len(w) // 3, OTHER - 1) for w, _ in common), 0], np.uint16)
        self.log = np.concatenate([np.zeros(len(n)), np.log([k for _, k in common]), [0.0]])

    def __getstate__(self) -> dict:
        return self.__dict__ | {"counts": None}

    def sort_into(self, classes: np.ndarray) -> None:
        """Sets the classes. within: of a head word; of another, what its count's logarithm is added to."""
        self.classes, v = classes, len(self.n)
        mass = np.bincount(classes[:v], self.n, CLASSES)
        self.within = np.append(np.log(self.n / mass[classes[:v]]) if v else [], -np.log(np.maximum(self.others, 1)))

    def learn(self, beside: np.ndarray) -> None:
        """Classes of the head's words by what stands beside them (k-means from the classes
        by weight); beside: a row of counts per code. Words alone in a class stay so."""
        v, first = len(self.n), 1 + OTHER + ALONE
        if v <= ALONE:
            return
        x = beside[ALONE:v].reshape(v - ALONE, 2, BESIDE) + 0.5 * beside[ALONE:v].sum(0).reshape(2, BESIDE) / max(1, beside[ALONE:v].sum())
        x = np.sqrt(x / np.maximum(x.sum(2, keepdims=True), 1e-9)).reshape(v - ALONE, -1)
        n, at = self.n[ALONE:], self.classes[ALONE:v] - first
        k = CLASSES - first
        middle = np.zeros((k, x.shape[1]))
        for _ in range(MOVES):
            mass = np.bincount(at, n, k)
            sums = np.stack([np.bincount(at, n * c, k) for c in x.T], 1)
            middle = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1)[:, None], middle)
            at = (np.square(middle).sum(1) - 2 * x @ middle.T).argmin(1)
        classes = self.classes.copy()
        classes[ALONE:v] = first + at
        self.sort_into(classes)

    def split(self, words: list[bytes]) -> tuple[np.ndarray, float, list[bytes]]:
        """Codes of the words, the sum of the logarithms of the common words' counts, and the words whose counts are not held."""
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        codes, unknown = self.code[at], np.flatnonzero(at < 0)
        others = [words[i] for i in unknown.tolist()]
        codes[unknown] = len(self.n) + np.minimum(np.fromiter(map(len, others), np.int64, len(others)) // 3, OTHER - 1)
        return codes, float(self.log[at].sum()), others

    def codes(self, words: list[bytes]) -> tuple[np.ndarray, float]:
        """Codes of one text's words, and the sum of the logarithms of the counts of those
        outside the head; what is not held is looked up in the table (on the driver)."""
        codes, total, others = self.split(words)
        if not others:
            return codes, total
        times = self.counts.sparkSession.createDataFrame([(bytearray(w), k) for w, k in Counter(others).items()], "word binary, times long")
        return codes, total + times.join(self.counts, "word").agg(F.sum(F.col("times") * F.log("n"))).first()[0]


def vocabulary(counts: DataFrame) -> Vocabulary:
    counts = checkpointed(counts)
    short = counts.where(F.length("word") <= LONGEST)
    # where rank VOCABULARY lies: only words from that step of counts on are sorted and sent; and the last whole step within rank COMMON
    step = F.floor(F.log2("n") * STEPS)
    rank, least, held = 0, None, None
    for r in sorted(short.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r.step):
        least = r.step if rank < VOCABULARY else least
        rank += r.words
        held = r.step if rank <= COMMON else held
    top = short.where(step >= least).orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
    head = {bytes(r.word) for r in top}
    found = short.where(step >= held).toArrow()
    common = [(w, n) for w, n in zip(found["word"].to_pylist(), found["n"].to_pylist()) if w not in head]
    others = np.zeros(OTHER)
    for r in counts.groupBy(F.least(F.floor(F.length("word") / 3), F.lit(OTHER - 1)).alias("class")).agg(F.sum("n").alias("n")).collect():
        others[r["class"]] = r.n
    for r in top:
        others[min(len(r.word) // 3, OTHER - 1)] -= r.n
    return Vocabulary([(bytes(r.word), r.n) for r in top], others, counts, common)


def coded(docs: DataFrame, words: Vocabulary, folder: str) -> DataFrame:
    """Per document: row (a number of its own), doc_id, slice, codes (two bytes for each word), common (the sum of the
    logarithms of its common words' counts) and its other words with how often each occurs. Written to folder, by slice."""
    held = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slices, codes, common, tail, times, ends = [], [], [], [], [], [0]
            for text in batch.column(1).to_pylist():
                slices.append(zlib.crc32((text or "").encode()) % ROUNDS)
                found, total, others = held.value.split(words_of(text))
                count = Counter(others)
                codes.append(found.tobytes())
                common.append(total)
                tail.extend(count.keys())
                times.extend(count.values())
                ends.append(len(tail))
            pairs = pa.StructArray.from_arrays([pa.array(tail, pa.binary()), pa.array(times, pa.int64())], ["word", "times"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(slices, pa.int32()), pa.array(codes, pa.binary()), pa.array(common, pa.float64()), lists], ["doc_id", "slice", "codes", "common", "tail"])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, slice int, codes binary, common double, tail array<struct<word: binary, times: long>>")
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    # each slice in as many files as there are cores: a round keeps all of them busy
    cores = docs.sparkSession.sparkContext.defaultParallelism
    rows.repartition(ROUNDS * cores, "slice", F.col("row") % cores).write.partitionBy("slice").parquet(folder)
    return docs.sparkSession.read.schema(rows.schema).parquet(folder)


def _groups(column: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The documents' codes, joined, and how many words each has; in groups of about size words."""

    def joined() -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(group), np.uint16), np.fromiter(map(len, group), np.int64, len(group)) // 2

    group, n = [], 0
    for c in column:
        c = c.as_py()
        group.append(c)
        n += len(c)
        if n >= 2 * size:
            yield joined()
            group, n = [], 0
    if group:
        yield joined()


class Network:
    """Classes on both sides -> hidden layer -> the middle word's class."""

    def __init__(self):
        draw = np.random.default_rng(SEED)
        self.sides = draw.normal(0, 0.3, (2 * WINDOW, CLASSES, HIDDEN)).astype(np.float32)
        self.bias = np.zeros(HIDDEN, np.float32)
        self.out = draw.normal(0, 0.3, (HIDDEN, CLASSES)).astype(np.float32)
        self.base = np.zeros(CLASSES, np.float32)

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.sides, self.bias, self.out, self.base]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts]).astype(np.float64)

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for p in self.parts:
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        return self

    def hidden(self, sides: np.ndarray) -> np.ndarray:
        h = self.sides[0].take(sides[0], 0)
        for k in range(1, 2 * WINDOW):
            h += self.sides[k].take(sides[k], 0)
        h += self.bias
        return np.tanh(h, out=h)

    def forward(self, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden layer and log-probabilities of the classes."""
        h = self.hidden(sides)
        z = h @ self.out + self.base
        z -= z.max(1, keepdims=True)
        z -= np.log(np.exp(z).sum(1, keepdims=True))
        return h, z

    def chances(self, sides: np.ndarray, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hidden layer; exp of the classes' values without base; their sums, weighted by exp(base); log-probabilities of the middle words."""
        h = self.hidden(sides)
        z = h @ self.out
        if np.abs(self.out).sum(0).max() > REACH:  # h is within -1 and 1
            z -= z.max(1, keepdims=True)
        own = z.ravel().take(np.arange(0, z.size, CLASSES) + middle) + self.base.take(middle)
        mass = np.exp(z, out=z) @ np.exp(self.base)
        return h, z, mass, own - np.log(mass)

    def gradient(self, sides: np.ndarray, middle: np.ndarray) -> np.ndarray:
        """Of the summed loss over some words, flat. By a class's value the loss changes by its probability,
        less one for the middle word's own; probabilities stay split into exp, exp(base) and mass, so no table of words by classes but one is made."""
        h, e, mass, _ = self.chances(sides, middle)
        times, share = np.exp(self.base), (1 / mass)[:, None]
        back = (e @ (self.out * times).T) * share - self.out.T.take(middle, 0)
        back *= 1 - h * h
        out = ((h * share).T @ e) * times - _sums(h, middle).T
        base = (share[:, 0] @ e) * times - np.bincount(middle, minlength=CLASSES)
        grads = [np.stack([_sums(back, s) for s in sides]), back.sum(0), out, base]
        return np.concatenate([d.ravel() for d in grads]).astype(np.float64)


def _sums(rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Per class, the sum of its rows."""
    order = classes.argsort(kind="stable")
    runs = classes[order]
    first = np.flatnonzero(np.append(True, runs[1:] != runs[:-1]))
    out = np.zeros((CLASSES, rows.shape[1]), rows.dtype)
    out[runs[first]] = np.add.reduceat(rows.take(order, 0), first, 0)
    return out


def _sides(classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of all words of some joined documents: the classes on their sides."""
    at = np.arange(len(classes)) + WINDOW * np.repeat(np.arange(1, len(lengths) + 1), lengths)
    run = np.zeros(len(classes) + WINDOW * (len(lengths) + 1), classes.dtype)
    run[at] = classes
    return np.stack([run[at + k] for k in (*range(-WINDOW, 0), *range(1, WINDOW + 1))])


def _contexts(classes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of all words of some documents: the classes on their sides, and their own."""
    own = np.concatenate(classes)
    return _sides(own, np.array([len(c) for c in classes])), own


def beside(rows: DataFrame, words: Vocabulary) -> np.ndarray:
    """Per code, how often each group of classes stands on its left and on its right."""
    held = rows.sparkSession.sparkContext.broadcast(words.classes * BESIDE // CLASSES)
    names = [f"b{i}" for i in range(2 * BESIDE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = held.value
        total = np.zeros(len(groups) * 2 * BESIDE, np.int64)
        for batch in batches:
            for codes, lengths in _groups(batch.column(0), 16 * BATCH):
                at = np.arange(len(codes)) + np.repeat(np.arange(1, len(lengths) + 1), lengths)
                run = np.zeros(len(codes) + len(lengths) + 1, np.int64)
                run[at] = groups[codes]
                place = codes.astype(np.int64) * 2 * BESIDE
                for side in (0, 1):
                    total += np.bincount(place + side * BESIDE + run[at + 2 * side - 1], minlength=len(total))
        total = total.reshape(-1, 2 * BESIDE)
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(c) for c in total[some].T)], ["code", *names])

    out = np.zeros((len(words.classes), 2 * BESIDE))
    found = rows.select("codes").mapInArrow(run, "code int, " + ", ".join(f"{n} long" for n in names))
    for r in found.groupBy("code").agg(*[F.sum(n).alias(n) for n in names]).collect():
        out[r.code] = r[1:]
    return out


def train(docs: DataFrame, words: Vocabulary, rows: DataFrame | None = None) -> Network:
    """Learns the classes of the head's words (set in words), then the network: in each round
    one step (Adagrad) by the gradients of a slice, summed over all tasks. rows: coded(docs, words)."""
    if rows is None:
        with _folder(docs.sparkSession) as folder:
            return train(docs, words, coded(docs, words, folder))
    words.learn(beside(rows, words))
    context = docs.sparkSession.sparkContext
    held, net = context.broadcast(words.classes.astype(np.uint8)), Network()
    weights = net.flat()
    speed = np.zeros_like(weights)
    for k in range(ROUNDS):
        now = context.broadcast(net)

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros(len(weights)), 0
            for batch in batches:
                for codes, lengths in _groups(batch.column(0), 16 * BATCH):
                    middle = held.value[codes]
                    sides = _sides(middle, lengths)
                    for i in range(0, len(middle), BATCH):
                        total += now.value.gradient(sides[:, i : i + BATCH], middle[i : i + BATCH])
                    seen += len(middle)
            if seen:
                cells = np.append(np.arange(len(total)), -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.append(total, float(seen)))], ["cell", "value"])

        found = rows.where(F.col("slice") == k).select("codes").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
        now.unpersist()
        if len(found):
            total = found.set_index("cell")["value"]
            step = (total[total.index >= 0].sort_index() / total[-1]).to_numpy()
            speed += step * step
            weights = weights - RATE * step / (np.sqrt(speed) + 1e-6)
            net = Network().load(weights)
    return net


@contextmanager
def _folder(spark: SparkSession) -> Iterator[str]:
    """A folder that the cluster shares, removed in the end."""
    name = shared_folder(spark)
    try:
        yield name
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def lm_score(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_tokens, pseudo_logprob, mean_logprob. Checkpointed."""
    words = vocabulary(word_counts(docs))
    with _folder(docs.sparkSession) as folder:
        rows = coded(docs, words, folder)
        return checkpointed(_scores(rows, words, train(docs, words, rows)))


def _scores(rows: DataFrame, words: Vocabulary, net: Network) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast((words.classes.astype(np.uint8), words.within, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, within, net = held.value
        for batch in batches:
            n, total = [], []
            for codes, lengths in _groups(batch.column(3), 16 * BATCH):
                middle = classes[codes]
                sides, chance = _sides(middle, lengths), within[codes]
                for k in range(0, len(middle), BATCH):
                    chance[k : k + BATCH] += net.chances(sides[:, k : k + BATCH], middle[k : k + BATCH])[3]
                n.append(lengths)
                total.append(np.bincount(np.repeat(np.arange(len(lengths)), lengths), chance, len(lengths)))
            if n:
                score = np.concatenate(total) + batch.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(n)), pa.array(score)], ["row", "doc_id", "n_tokens", "score"])

    scored = rows.select("row", "doc_id", "common", "codes").mapInArrow(run, "row long, doc_id long, n_tokens long, score double")
    # a word that occurs once adds log(1) = 0
    tail = rows.selectExpr("row", "inline(tail)").join(words.counts.where("n > 1"), "word")
    tail = tail.groupBy("row").agg(F.sum(F.col("times") * F.log("n")).alias("tail"))
    total = F.col("score") + F.coalesce("tail", F.lit(0.0))
    out = scored.join(tail, "row", "left").select("doc_id", "n_tokens", total.alias("pseudo_logprob"))
    return out.withColumn("mean_logprob", F.when(F.col("n_tokens") > 0, F.col("pseudo_logprob") / F.col("n_tokens")))
