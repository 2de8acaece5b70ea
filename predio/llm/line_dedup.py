"""Line dedup over an index that can be added to and taken from.

The exact state is a table of reference counts: one row per line key with the number of
documents that hold it and the largest of them. Beside it stand cuckoo filters, one per
shard of the key space, of the keys that are repeated (held by at least `min_docs`
documents). Filters answer "maybe repeated" in two bytes a key; what they let through is
confirmed against the counts. Adding documents adds to the counts, deleting documents
subtracts, and a filter takes in or gives up the keys that cross `min_docs`, so a
deletion restores the state as it was before the insertion.

A document counts a key once, however often it holds it. Counts are summed map-side, so
one line in a third of all documents costs each task one row.

Defined results: a null or empty text is one empty line; lines of fewer than `min_chars`
code points stay; if all lines go, the text is empty. Rows with equal doc_id are counted
as documents of their own, and those with the largest doc_id all keep the line. A row
without doc_id counts for nothing and keeps its lines. An empty table gives an empty
table. Other columns are neither read nor returned by `line_dedup`; `dedup_texts` returns
the columns of the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from predio.llm.common import checkpointed

BLANK = "\t\n\x0b\x0c\r "
MIN_CHARS, MIN_DOCS = 40, 5
#: Keys a shard's filter is laid out for, about.
SHARD_KEYS = 1 << 16
SLOTS, KICKS = 4, 500
KEYS = "k1 long, k2 long"


def line_keys(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each line's key as two int64 columns, and the keys' lengths in code points."""
    keys = pc.ascii_lower(pc.utf8_trim(lines, characters=BLANK))
    size = pc.utf8_length(keys).to_numpy(zero_copy_only=False)
    return keys, size


def digest(keys: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(k.encode(), digest_size=16).digest() for k in keys), np.int64).reshape(-1, 2)


def _long_lines(texts: pa.Array, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every line with a long key: its document's row in the batch, its line number
    and the two halves of its key. Last: the number of lines of each document."""
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    n = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    keys, size = line_keys(pc.list_flatten(lines))
    row = np.repeat(np.arange(len(n)), n)
    number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = np.flatnonzero(size >= min_chars)
    return row[at], number[at], digest(keys.take(pa.array(at)).to_pylist()), n


class CuckooFilter:
    """Partial-key cuckoo filter over pairs of int64: insert, delete, contains.

    A key lies in one of two buckets of four 16-bit fingerprints. Keys that find no place
    after `KICKS` moves are kept in an overflow list, so no key is ever lost.
    """

    def __init__(self, n_buckets: int, table: np.ndarray | None = None, over: list[tuple[int, int]] | None = None):
        self.n = n_buckets
        self.table = np.zeros((n_buckets, SLOTS), np.uint16) if table is None else table
        self.over = over or []

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        return cls(1 << max(1, int(np.ceil(np.log2(max(1, n) / SLOTS / 0.85)))))

    def _places(self, k1, k2):
        k1, k2 = np.asarray(k1, np.int64).view(np.uint64), np.asarray(k2, np.int64).view(np.uint64)
        mark = ((k2 >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        first = (k1 & np.uint64(self.n - 1)).astype(np.int64)
        return mark, first, self._other(first, mark)

    def _other(self, bucket, mark):
        return bucket ^ ((np.asarray(mark, np.int64) * 0x5BD1E995) & (self.n - 1))

    def insert(self, k1: int, k2: int) -> None:
        mark, a, b = (int(x[0]) for x in self._places([k1], [k2]))
        for place in (a, b):
            if len(free := np.flatnonzero(self.table[place] == 0)):
                self.table[place, free[0]] = mark
                return
        place = a
        for i in range(KICKS):
            slot = i % SLOTS
            mark, self.table[place, slot] = int(self.table[place, slot]), mark
            place = int(self._other(place, mark))
            if len(free := np.flatnonzero(self.table[place] == 0)):
                self.table[place, free[0]] = mark
                return
        self.over.append((place, mark))

    def delete(self, k1: int, k2: int) -> bool:
        """Takes one copy of the key's fingerprint out; the key must have been inserted."""
        mark, a, b = (int(x[0]) for x in self._places([k1], [k2]))
        for place in (a, b):
            if len(held := np.flatnonzero(self.table[place] == mark)):
                self.table[place, held[0]] = 0
                return True
        for place in (a, b):
            if (place, mark) in self.over:
                self.over.remove((place, mark))
                return True
        return False

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(k1, k2)
        found = (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)
        if self.over:
            code = np.array([(place << 16) | held for place, held in self.over], np.int64)
            found |= np.isin((a << 16) | mark, code) | np.isin((b << 16) | mark, code)
        return found

    def full(self) -> bool:
        """Whether keys that were added since it was sized crowd it."""
        return int((self.table > 0).sum()) + len(self.over) > 0.95 * self.table.size

    def dump(self) -> bytes:
        over = np.array(self.over, np.int64).reshape(-1, 2)
        return np.int64(self.n).tobytes() + self.table.tobytes() + over.tobytes()

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        n = int(np.frombuffer(data[:8], np.int64)[0])
        end = 8 + 2 * n * SLOTS
        over = np.frombuffer(data[end:], np.int64).reshape(-1, 2)
        return cls(n, np.frombuffer(data[8:end], np.uint16).reshape(n, SLOTS).copy(), [(int(a), int(b)) for a, b in over])


def postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """k1, k2, doc_id: each document's distinct long keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, _, key, _ = _long_lines(batch.column(1), min_chars)
            if len(row):
                order = np.lexsort((key[:, 1], key[:, 0], row))
                row, key = row[order], key[order]
                new = np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1]).any(1))
                yield pa.RecordBatch.from_arrays([pa.array(key[new, 0]), pa.array(key[new, 1]), batch.column(0).take(pa.array(row[new]))], ["k1", "k2", "doc_id"])

    return docs.where("doc_id is not null").selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, KEYS + ", doc_id long")


def reference_counts(posts: DataFrame) -> DataFrame:
    """The exact table: k1, k2, refs (documents that hold the key), last_doc."""
    return posts.groupBy("k1", "k2").agg(F.count("*").alias("refs"), F.max("doc_id").alias("last_doc"))


def insert_documents(counts: DataFrame, docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The reference counts with more documents."""
    more = reference_counts(postings(docs, min_chars))
    return counts.unionByName(more).groupBy("k1", "k2").agg(F.sum("refs").alias("refs"), F.max("last_doc").alias("last_doc"))


def delete_documents(counts: DataFrame, gone: DataFrame, rest: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The reference counts without the documents `gone`. `rest`: the documents that stay;
    it is read only for the keys whose last document goes."""
    less = reference_counts(postings(gone, min_chars)).select("k1", "k2", F.col("refs").alias("less"), F.col("last_doc").alias("gone_doc"))
    left = counts.join(less, ["k1", "k2"], "left").withColumn("refs", F.col("refs") - F.coalesce("less", F.lit(0))).where("refs > 0")
    lost = F.coalesce(F.col("gone_doc") >= F.col("last_doc"), F.lit(False))
    kept = left.where(~lost).select("k1", "k2", "refs", "last_doc")
    again = left.where(lost).select("k1", "k2", "refs")
    last = postings(rest, min_chars).join(again, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.max("doc_id").alias("last_doc"))
    return kept.unionByName(again.join(last, ["k1", "k2"]))


def shard_filters(repeated: DataFrame, n_shards: int) -> DataFrame:
    """shard, filter: a cuckoo filter of each shard's keys (k1, k2)."""

    def build(group: pa.Table) -> pa.Table:
        k1, k2 = group["k1"].to_numpy(), group["k2"].to_numpy()
        order = np.lexsort((k2, k1))
        made = CuckooFilter.for_keys(len(k1))
        for a, b in zip(k1[order].tolist(), k2[order].tolist()):
            made.insert(a, b)
        return pa.table({"shard": group["shard"].slice(0, 1), "filter": pa.array([made.dump()], pa.binary())})

    return repeated.select(F.pmod(F.shiftright("k1", 40), F.lit(n_shards)).cast("int").alias("shard"), "k1", "k2").groupBy("shard").applyInArrow(build, "shard int, filter binary")


def update_filters(filters: DataFrame, crossed: DataFrame, repeated: DataFrame, n_shards: int) -> DataFrame:
    """Filters after keys crossed the threshold. crossed: k1, k2, enters (boolean). A filter
    that is full is made anew, larger, from its shard's keys in `repeated`."""
    moved = crossed.select(F.pmod(F.shiftright("k1", 40), F.lit(n_shards)).cast("int").alias("shard"), "k1", "k2", "enters")

    def change(old: pa.Table, new: pa.Table) -> pa.Table:
        made = CuckooFilter.load(old["filter"][0].as_py()) if old.num_rows else CuckooFilter.for_keys(new.num_rows)
        for a, b, enters in sorted(zip(*(new[c].to_pylist() for c in ("k1", "k2", "enters")))):
            (made.insert if enters else made.delete)(a, b)
        shard = (old if old.num_rows else new)["shard"].slice(0, 1)
        return pa.table({"shard": shard, "filter": pa.array([None if made.full() else made.dump()], pa.binary())})

    changed = checkpointed(filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInArrow(change, "shard int, filter binary"))
    crowded = repeated.withColumn("shard", F.pmod(F.shiftright("k1", 40), F.lit(n_shards)).cast("int")).join(changed.where("filter is null").select("shard"), "shard", "left_semi")
    return changed.where("filter is not null").unionByName(shard_filters(crowded, n_shards))


class LineIndex:
    """The reference counts of all long lines and the filters of those that repeat.

    `add` and `delete` give the index after a change of the documents: the counts change by
    those of the documents alone, and keys that thereby cross the threshold enter or leave
    their shard's filter. So deleting what was added gives the same counts and answers.
    """

    def __init__(self, counts: DataFrame, filters: DataFrame, n_shards: int, min_chars: int, min_docs: int):
        self.counts, self.filters, self.n_shards, self.min_chars, self.min_docs = counts, filters, n_shards, min_chars, min_docs

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, n_shards: int | None = None) -> LineIndex:
        """n_shards: default by the number of repeated keys; give more for an index that will grow."""
        counts = reference_counts(postings(docs, min_chars))
        repeated = checkpointed(counts.where(F.col("refs") >= min_docs))
        n_shards = n_shards or max(1, -(-repeated.count() // SHARD_KEYS))
        made = cls(counts, shard_filters(repeated, n_shards), n_shards, min_chars, min_docs)
        made._repeated = repeated
        return made

    @property
    def repeated(self) -> DataFrame:
        return getattr(self, "_repeated", None) or self.counts.where(F.col("refs") >= self.min_docs)

    def _changed(self, counts: DataFrame) -> LineIndex:
        counts = checkpointed(counts)
        before, after = self.counts.select("k1", "k2", F.col("refs").alias("before")), counts.select("k1", "k2", F.col("refs").alias("after"))
        often = lambda c: F.coalesce(F.col(c), F.lit(0)) >= self.min_docs
        crossed = before.join(after, ["k1", "k2"], "full").where(often("before") != often("after")).select("k1", "k2", often("after").alias("enters"))
        filters = update_filters(self.filters, crossed, counts.where(F.col("refs") >= self.min_docs), self.n_shards)
        return LineIndex(counts, checkpointed(filters), self.n_shards, self.min_chars, self.min_docs)

    def add(self, docs: DataFrame) -> LineIndex:
        return self._changed(insert_documents(self.counts, docs, self.min_chars))

    def delete(self, gone: DataFrame, rest: DataFrame) -> LineIndex:
        """rest: the documents that stay."""
        return self._changed(delete_documents(self.counts, gone, rest, self.min_chars))

    def lost(self, docs: DataFrame) -> DataFrame:
        """doc_id and the packed keys of which the document, one of the index, loses its lines."""
        partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        maybe = _maybe_repeated(postings(docs, self.min_chars), self.filters, self.n_shards, max(1, -(-4 * partitions // self.n_shards)))
        found = maybe.join(self.repeated, ["k1", "k2"]).where("doc_id < last_doc")
        return found.groupBy("doc_id").agg(F.collect_list(F.struct("k1", "k2")).alias("lost"))


def _maybe_repeated(posts: DataFrame, filters: DataFrame, n_shards: int, salts: int) -> DataFrame:
    """The postings that their shard's filter lets through. Postings of a shard are dealt
    over `salts` tasks, each with a copy of the filter, so a frequent line isn't one task's."""
    p = posts.select("*", F.pmod(F.shiftright("k1", 40), F.lit(n_shards)).cast("int").alias("shard"), F.pmod(F.hash("doc_id"), F.lit(salts)).alias("salt"))
    f = filters.select("shard", "filter", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.select(["k1", "k2", "doc_id"])
        if not right.num_rows:
            return rows.slice(0, 0)
        held = CuckooFilter.load(right["filter"][0].as_py())
        return rows.filter(pa.array(held.contains(rows["k1"].to_numpy(), rows["k2"].to_numpy())))

    return p.groupBy("shard", "salt").cogroup(f.groupBy("shard", "salt")).applyInArrow(probe, KEYS + ", doc_id long")


def _flagged(docs: DataFrame, index: LineIndex) -> DataFrame:
    """docs with a further last column: the keys whose lines go, or null."""
    name = "lost"
    while name in [x.lower() for x in docs.columns]:
        name += "_"
    lost = index.lost(docs).withColumnRenamed("doc_id", "lost_id")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"))  # whatever the columns' names
    return rows.join(lost, F.col("id") == F.col("lost_id"), "left").select("row.*", F.col("lost").alias(name))


def _keep(texts: pa.Array, lost: pa.Array, min_chars: int) -> Iterator[tuple[str, int, int]]:
    """Of each document: the text of its kept lines, its lines and its dropped lines."""
    row, number, key, n = _long_lines(texts, min_chars)
    start = np.searchsorted(row, np.arange(len(n) + 1))
    for i, (text, keys) in enumerate(zip(texts, lost)):
        text = text.as_py() or ""
        if not keys.is_valid:
            yield text, int(n[i]), 0
            continue
        gone = np.array([(k["k1"], k["k2"]) for k in keys.as_py()], np.int64)
        mine, at = key[start[i] : start[i + 1]], number[start[i] : start[i + 1]]
        drop = set(at[np.isin(mine[:, 0], gone[:, 0]) & np.isin(mine[:, 1], gone[:, 1])].tolist())
        yield "\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop), int(n[i]), len(drop)


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, index: LineIndex | None = None) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256, kept_text. index: of
    documents that docs are part of; default: of docs."""
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    index = index or LineIndex.build(docs, min_chars, min_docs)
    min_chars = index.min_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(n, gone, hashlib.sha256(t.encode()).hexdigest(), t) for t, n, gone in _keep(batch.column(1), batch.column(2), min_chars)]
            cols = [pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string()))] if out else [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text"])

    return _flagged(docs, index).mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept_text string")


def dedup_texts(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents with their repeated lines gone, in the columns of docs."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("text")
            kept = [t if text.is_valid or t else None for (t, _, _), text in zip(_keep(batch.column(at), batch.column(len(names)), min_chars), batch.column(at))]
            cols = [pa.array(kept, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names)

    return _flagged(docs, LineIndex.build(docs, min_chars, min_docs)).mapInArrow(run, docs.schema)
