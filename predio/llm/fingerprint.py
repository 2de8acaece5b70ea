"""Document fingerprints: a quartile bucket digest.

Every window of four bytes gives three byte triplets; each is hashed to one of 128
buckets. The buckets' counts are coded by the quartile they fall in (two bits each), next
to the length's logarithm and the quartiles' ratios. The difference of two digests is the
summed distance of their codes, bounded, and likeness is one minus its share of the bound.

The edited text needs the next document by doc_id. Documents are range-sorted by doc_id
and each task walks its own range; only each range's first and last document meet those
of the neighbouring range, by a join of one row per range.

Defined results: a null text is the empty text; all texts of fewer than four bytes have
empty buckets and differ in their length code only; rows with equal doc_id stand in the
order of their texts; a null doc_id comes before all others; the last document's next one
is the first, so a single document is its own next one; an empty table gives an empty
table; other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from predio.llm.common import checkpointed

BUCKETS = 128
#: Offsets of the triplets in a window of four bytes.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
#: Difference from which two digests have no likeness.
BOUND = 160
PIECE = 1 << 18


def bucket_counts(data: bytes) -> np.ndarray:
    """Counts of a text's hashed triplets, taken piece by piece so a long text needs little memory."""
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(0, len(data) - 3), PIECE):
        t = np.frombuffer(data[at : at + PIECE + 3], np.uint8).astype(np.uint32)
        n = len(t) - 3
        for k, places in enumerate(TRIPLETS):
            h = np.full(n, 0x27D4EB2F * (k + 1) & 0xFFFFFFFF, np.uint32)
            for place, by in zip(places, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
                h += t[place : place + n] * np.uint32(by)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            counts += np.bincount(h >> np.uint32(25), minlength=BUCKETS)
    return counts


def fingerprint(text: str) -> str:
    """70 hex digits: length code, the quartiles' ratios, two bits for each bucket."""
    data = text.encode()
    counts = bucket_counts(data)
    q = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (counts[:, None] > q[None, :]).sum(1).astype(np.uint8)
    length = min(255, round(8 * np.log2(len(data) + 1)))
    ratios = [min(15, int(15 * x / max(1, q[2]))) for x in q[:2]]
    body = code[0::4] | code[1::4] << 2 | code[2::4] << 4 | code[3::4] << 6
    return f"{length:02x}{ratios[0]:02x}{ratios[1]:02x}" + body.astype(np.uint8).tobytes().hex()


def _parts(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(prints)), np.uint8).reshape(len(prints), -1)
    body = np.stack([raw[:, 3:] >> s & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(prints), -1)
    return raw[:, :3].astype(np.int64), body.astype(np.int64)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """1 for equal digests, down to 0 from the bound on."""
    if not left:
        return np.zeros(0)
    (head, body), (head2, body2) = _parts(left), _parts(right)
    d = np.abs(body - body2)
    d = np.where(d == 3, 6, d).sum(1) + np.abs(head - head2).sum(1)
    return 1 - np.minimum(d, BOUND) / BOUND


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def edit(text: str, following: str) -> str:
    """The last quarter replaced by the start of the next document."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _results(ids: list, texts: list[str], prints: list[str], next_texts: list[str], next_prints: list[str]) -> list:
    edited = [edit(a, b) for a, b in zip(texts, next_texts)]
    edited_prints = [fingerprint(x) for x in edited]
    sums = [hashlib.sha256(x.encode()).hexdigest() for x in edited]
    return [ids, [len(x) for x in texts], sums, prints, edited_prints, likeness(prints, edited_prints), likeness(prints, next_prints)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last = TaskContext.get().partitionId(), None, None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            prints = [fingerprint(x) for x in texts]
            if ids and first is None:
                first = texts[0]
            if last is not None:
                ids, texts, prints = [last[0], *ids], [last[1], *texts], [last[2], *prints]
            if ids:
                last = ids[-1], texts[-1], prints[-1]
                cols = [pa.array(x, k) for x, k in zip(_results(ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:]), KINDS)]
                n = len(ids) - 1
                yield pa.RecordBatch.from_arrays([*cols, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], [*NAMES, "part", "text", "first"])
        if last is not None:  # its next one is in another range
            rest = [pa.nulls(1, k) for k in KINDS[1:]]
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), *rest, pa.array([part], pa.int32()), pa.array([last[1]]), pa.array([first])], [*NAMES, "part", "text", "first"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, following = (c.to_pylist() for c in batch.columns)
            cols = _results(ids, texts, [fingerprint(x) for x in texts], following, [fingerprint(x) for x in following])
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, KINDS)], NAMES)

    ordered = docs.selectExpr("cast(doc_id as long) doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    walked = checkpointed(ordered.mapInArrow(walk, SCHEMA + ", part int, text string, first string"))
    ends = walked.where("part is not null").select("doc_id", "part", "text", "first")
    # the order of the ranges: one number each
    order, every = Window.orderBy("part"), Window.partitionBy()
    following = ends.select("part").select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(every)).alias("next_part"))
    firsts = ends.select(F.col("part").alias("next_part"), F.col("first").alias("following"))
    joined = ends.join(following, "part").join(firsts, "next_part").select("doc_id", "text", "following")
    return walked.where("part is null").select(*NAMES).unionByName(joined.mapInArrow(finish, SCHEMA))
