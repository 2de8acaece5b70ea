"""Quality classifier: random Fourier features, ridge, isotonic calibration.

Statistics of each text are standardised and mapped to random Fourier features, which
approximate a Gaussian kernel. The normal equations of ridge regression are sums over
rows: every task sums its own, Spark adds the tasks' cells, and the driver solves a
system whose size is fixed by the number of features. Calibration is isotonic, on counts
of labels in a fixed number of bins of the score. All labelled training rows are used.

Defined results: a null text is the empty text, with statistics of zero, and is scored;
labels that are null aren't learnt from; a document labelled several times is learnt from
as often; with no training rows every score is 0.5; rows with equal doc_id are scored
each by its own text; an empty table gives an empty table; no column but doc_id and text
is read or returned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from predio.llm.common import checkpointed

THRESHOLD = 0.3
FEATURES, BANDWIDTH, RIDGE, SEED = 192, 4.0, 1e-3, 20
BINS = 2000
STATS = (
    "log_words", "symbols", "capitals", "digits", "marks", "other_marks", "word_length", "distinct_words", "repeated_windows",
    "twins", "dup_lines", "line_words", "beyond_ascii", "entropy", "top_word", "sentence_marks",
)
#: Characters counted together, by class of byte.
CLASSES = {"symbols": b"#*$%&|<>", "marks": b"!?", "other_marks": b"@_=+~^\\/[]{}`", "sentence_marks": b".,;:"}


def statistics(text: str) -> list[float]:
    """STATS of a text."""
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = text.split()
    n, size = len(words), len(data)
    if not n:
        return [0.0] * len(STATS)
    of = {k: float(counts[list(v)].sum()) / n for k, v in CLASSES.items()}
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    used = Counter(words)
    windows = Counter(zip(words, words[1:], words[2:]))
    again = sum(v for v in windows.values() if v > 1)
    lines = [x for x in text.split("\n") if x.strip()]
    share = counts[counts > 0] / size
    return [
        np.log1p(n), of["symbols"], float(upper) / max(1.0, float(upper + lower)), float(counts[48:58].sum()) / size, of["marks"], of["other_marks"],
        min(30.0, len(text) / n), len(used) / n, again / n, sum(map(str.__eq__, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), float(counts[128:].sum()) / size, float(-(share * np.log2(share)).sum()),
        max(used.values()) / n, of["sentence_marks"],
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stats array<double>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "stats"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, stats array<double>")


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten(), np.float64).reshape(len(column), len(STATS))


class Model:
    """Standardisation, feature map, ridge weights and calibration; a few hundred kB at most."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        draw = np.random.default_rng(SEED)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.turn = draw.normal(0, 1 / BANDWIDTH, (len(STATS), FEATURES))
        self.shift = draw.uniform(0, 2 * np.pi, FEATURES)
        self.weights: np.ndarray | None = None
        self.at, self.value = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.deviation, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.turn + self.shift), np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.full(len(stats), 0.5) if self.weights is None else np.clip(np.interp(self.raw(stats), self.at, self.value), 0, 1)


def isotonic(at: np.ndarray, ones: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the blocks' places and their increasing shares of ones."""
    blocks: list[list[float]] = []
    for x, k, m in sorted(zip(at, ones, n)):
        blocks.append([x * m, k, m])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(stats: DataFrame, labels: DataFrame, target: str = "quality") -> Model:
    """Learns from the labelled rows that aren't held out."""
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").alias("__id"), F.col(target).cast("double").alias("__y"))
    rows = checkpointed(stats.join(known, F.col("doc_id") == F.col("__id")).select("stats", F.col("__y").alias("y")))
    moments = rows.agg(F.count("*"), *[f(F.col("stats")[i]) for f in (F.avg, F.stddev_pop) for i in range(len(STATS))]).first()
    if not moments[0]:
        return Model(np.zeros(len(STATS)), np.ones(len(STATS)))
    k = len(STATS)
    model = Model(np.array(moments[1 : k + 1]), np.array(moments[k + 1 :]))
    size = FEATURES + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                x = model.features(_matrix(batch.column(0)))
                total += x.T @ np.column_stack([x, np.asarray(batch.column(1))])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["cell", "value"])

    cells = rows.mapInArrow(sums, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    total = np.zeros(size * (size + 1))
    total[cells["cell"].to_numpy()] = cells["value"].to_numpy()
    total = total.reshape(size, size + 1)
    model.weights = np.linalg.solve(total[:, :-1] + RIDGE * moments[0] * np.eye(size) / size, total[:, -1])

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.clip(np.round((model.raw(_matrix(batch.column(0))) + 0.5) / 2 * BINS), 0, BINS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], ["bin", "y"])

    found = rows.mapInArrow(bins, "bin int, y double").groupBy("bin").agg(F.sum("y").alias("ones"), F.count("*").alias("n")).toPandas()
    model.at, model.value = isotonic(found["bin"].to_numpy() / BINS * 2 - 0.5, found["ones"].to_numpy(), found["n"].to_numpy())
    return model


def classify(docs: DataFrame, labels: DataFrame, target: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    stats = checkpointed(document_statistics(docs))
    model = fit(stats, labels, target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    out = F.coalesce(held_out(), F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
