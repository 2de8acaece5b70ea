"""Vector code compression: product codes with exact integer k-means and exponion search.

Each component x becomes floor(256 * x); a vector is cut into `PARTS` equal parts and
each part is coded by the nearest of its position's `ENTRIES` codebook entries (squared
Euclidean distance in integers, ties to the lower index). Codebooks start as the parts of the
first kept vectors by vec_id and are replaced `ROUNDS` times by the componentwise
floor of the mean of what was assigned to them.

Exponion search: a part starts at the entry that it had before, at squared distance u. An
entry at more than twice that distance from the starting one (squared: above 4u) can't be
as near, by the triangle inequality, so only the starting entry's neighbours inside
that ball are looked at, in the order of their distance from it. A part without a code
starts at entry 0. A batch's parts go through their lists together, the n-th neighbours at once.

A round is one pass over the vectors, which carry their codes, and leaves them written in the
shared folder; the tasks' sums, at most PARTS * ENTRIES rows each, are added by Spark and the
driver gets one row per entry. Errors by label are summed before the shuffle and come back
to the rows by a join on label and salt, so a label may hold any share of the rows.

Defined results: rows whose vector is null or empty or holds null, NaN or infinite components
are dropped; of the others, those that don't have the first kept vector's length, or have a
component of 2**18 or more in size (whose sums leave 64 bits), keep a null code and error
and take no part, nor do they name the length; a length that PARTS doesn't divide is an
error; rows without vec_id are coded but never start a codebook unless no row has one; rows with
equal vec_id stand in the order of their vectors; with fewer vectors than ENTRIES there are as
many entries; label_error is null if no row of that label has an error; an empty table gives an
empty table; other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from predio.llm.common import checkpointed

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components from this size on are not coded.
TOO_LARGE = 1 << 18
#: Copies of a label's sum among which its rows are dealt.
SALTS = 64
#: Vectors that a task works on at a time.
BLOCK = 4096
CODED = "vec_id long, label int, ints array<int>, code binary, error long"


def neighbours(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: all entries by distance from it, itself first, and those squared distances."""
    far = ((book[:, None, :] - book[None, :, :]) ** 2).sum(2)
    far[np.arange(len(book)), np.arange(len(book))] = -1  # before equal entries
    order = np.argsort(far, axis=1, kind="stable")
    return order, np.maximum(np.take_along_axis(far, order, 1), 0)


def nearest(points: np.ndarray, book: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each point, its squared distance, and how many distances were
    computed. start: the entry from which each point's search begins."""
    order, far = neighbours(book)
    best, least = start.astype(np.int64), ((points - book[start]) ** 2).sum(1)
    asked = len(points)
    inside = (far[start] <= 4 * least[:, None]).sum(1)  # entries in each point's ball
    rows = np.argsort(-inside, kind="stable")
    deeper = np.searchsorted(-inside[rows], -np.arange(1, len(book)), side="left")  # points with more than 1, 2, ... inside
    for k in range(1, len(book)):
        near = rows[: deeper[k - 1]]
        if not len(near):
            break
        j = order[start[near], k]
        d = ((points[near] - book[j]) ** 2).sum(1)
        asked += len(near)
        better = (d < least[near]) | ((d == least[near]) & (j < best[near]))
        best[near[better]], least[near[better]] = j[better], d[better]
    return best, least, asked


def coded(ints: np.ndarray, books: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (vector, part) and summed squared distances. books: part, entry, component."""
    parts, _, wide = books.shape
    codes, error = np.empty((len(ints), parts), np.uint8), np.zeros(len(ints), np.int64)
    for p in range(parts):
        codes[:, p], least, _ = nearest(ints[:, p * wide : (p + 1) * wide], books[p], start[:, p])
        error += least
    return codes, error


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.astype(np.int32).ravel()))


def _assigned(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vectors with code and error by these codebooks; the search starts at the code they have."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    wide = books.shape[0] * books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                ints = piece.column("ints").flatten().to_numpy().astype(np.int64).reshape(-1, wide)
                start = np.zeros((len(ints), books.shape[0]), np.int64)
                if piece.num_rows and piece.column("code").null_count == 0:
                    start[:] = np.frombuffer(b"".join(piece.column("code").to_pylist()), np.uint8).reshape(start.shape)
                codes, error = coded(ints, shared.value, start)
                cols = [piece.column("vec_id"), piece.column("label"), _lists(ints), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "label", "ints", "code", "error"])

    return vectors.mapInArrow(run, CODED)


def _means(assigned: DataFrame, books: np.ndarray) -> np.ndarray:
    """books with each entry that has parts replaced by the floor of their mean."""
    parts, entries, wide = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, wide), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if batch.num_rows:
                ints = batch.column("ints").flatten().to_numpy().astype(np.int64).reshape(-1, parts, wide)
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
                for p in range(parts):
                    np.add.at(total[p], codes[:, p], ints[:, p])
                    count[p] += np.bincount(codes[:, p], minlength=entries)
        p, e = np.nonzero(count)
        cols = [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * wide), pa.array(total[p, e].ravel()))]
        yield pa.RecordBatch.from_arrays(cols, ["part", "entry", "n", "sums"])

    sums = assigned.mapInArrow(run, "part int, entry int, n long, sums array<long>").groupBy("part", "entry")
    new = books.copy()
    for r in sums.agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(wide)]).collect():
        new[r["part"], r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(wide)]
    return new


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per kept vector: vec_id, label, code (two hex digits for each part), error,
    label_error (errors summed over equal labels, nulls together) and codebooks_sha256."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte for each part: at most 256 entries")
    x = F.col("embedding")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    kept = kept.where(F.coalesce((F.size(x) > 0) & ~F.exists(x, bad), F.lit(False)))
    fits = kept.where(~F.exists(x, lambda v: F.abs(v) >= TOO_LARGE))
    ints = lambda v: F.transform(v, lambda c: F.floor(c * scale).cast("int"))
    asc = [F.col("vec_id").asc_nulls_last(), x]
    first = fits.orderBy(*asc).select(F.size(x).alias("n")).first()
    if first is None:
        return kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("long").alias("label_error"), F.lit(books_sha256(np.zeros(0, np.int64))).alias("codebooks_sha256"))
    length = first["n"]
    if length % parts:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    fits = fits.where(F.size(x) == length)
    named = fits.where("vec_id is not null").orderBy(*asc).limit(entries).select(ints(x).alias("ints")).collect()
    seeds = named or fits.orderBy(*asc).limit(entries).select(ints(x).alias("ints")).collect()
    books = np.array([r["ints"] for r in seeds], np.int64).reshape(len(seeds), parts, length // parts).transpose(1, 0, 2).copy()

    vectors = fits.select("vec_id", "label", ints(x).alias("ints"), F.lit(None).cast("binary").alias("code"))
    for _ in range(rounds):
        vectors = checkpointed(_assigned(vectors, books))
        books = _means(vectors, books)
    ended = checkpointed(_assigned(vectors, books).select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error"))
    odd = kept.where((F.size(x) != length) | F.exists(x, lambda v: F.abs(v) >= TOO_LARGE))
    every = ended.unionByName(odd.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    by_label = every.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("of"), "label_error", salts.alias("salt_of"))
    salted = every.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    joined = salted.join(by_label, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("salt_of")))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
