"""Spelling variants by Aho-Corasick automata over the halves of words.

Words are counted in tasks and summed by Spark. Two words at distance one (one code point
inserted, deleted or replaced) share a half: if the edit lies in a word's second half, its
first half starts the other word; if it lies in the first half, the second half ends the
other word.

1. Every word owns its two segments. Segments are dealt to shards by hash, and a word is sent
   to the shards in which its possible partners' segments can be: partners are at most one code
   point longer or shorter, so it has two possible prefixes and two suffixes.
2. A shard builds one automaton over its segments and scans its words with it. A match
   counts if it is a first half at offset 0 or a second half at the word's end.
3. The owners of a matched segment whose length is compatible are found by what is left
   of both words without one code point, not by comparing all owners: an owner's rest
   is listed without each of its code points, and the word's rest asks for itself and for each of its own
   shortenings. Each find is checked by comparing the words.
4. A pair that both halves show is counted by the first one only. A shard returns each word's
   number of near words and the best of them; Spark sums those up.

A segment with more than `HOT` owners gets shards of its own: a grid in which its owners are
dealt over rows and the words that hold it over columns, so that no task holds all of either. There are
at most 2 * words / HOT such segments; the table of them is broadcast.

Forms point to words at least ten times as frequent, so a chain has at most as many steps as the
largest count has digits; roots are found by pointer jumping, doubling the steps with each join.

Defined results: a null or empty text has no words; without doc_id the digest is taken of
`:<run>`; only A-Z are lower-cased; rows with equal doc_id are counted each; an empty table
gives an empty table; other columns are neither read nor returned.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from predio.llm.common import checkpointed

LEAST, TIMES, FACTOR, EVERY = 7, 2, 10, 31
#: Segments in a shard, about, and owners from which a segment is dealt over a grid of shards.
SHARD, HOT = 20_000, 5_000
#: Different words counted in a task before they are handed on.
COUNTED = 200_000
FIRST, LAST = "p", "s"
#: Code points from which the rest of a word is found by its halves again, so that its keys stay few.
LONG = 40
#: Doubled steps: chains of up to 2 ** JUMPS forms, above the digits of any 64-bit count.
JUMPS = 5


def changed(run: str, digest: int, every: int = EVERY) -> str:
    """The run, without one code point if its digest is divisible by `every`."""
    k = digest % len(run)
    return run[:k] + run[k + 1 :] if digest % every == 0 else run


def word_counts(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """word, n: the words of at least `least` code points and at least `times` occurrences."""
    runs = re.compile(rf"[a-zÀ-ÿ]{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = (text.as_py() or "").encode().lower().decode()  # bytes: A-Z only
                start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for found, n in Counter(runs.findall(text)).items():
                    word = changed(found, zlib.crc32(found.encode(), start))
                    if len(word) >= least:
                        total[word] += n
                if len(total) >= COUNTED:
                    yield out()
                    total.clear()
        yield out()

    counted = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def one_apart(a: str, b: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def _shorter(rest: str) -> set[str]:
    return {rest, *(rest[:i] + rest[i + 1 :] for i in range(len(rest)))}


def owned_keys(rest: str) -> set:
    """Under what an owner's rest is listed: without each of its code points; a long one by its halves."""
    if len(rest) <= LONG:
        return _shorter(rest)
    k = len(rest) // 2
    return {(FIRST, rest[:k]), (LAST, rest[k:])}


def asked_keys(rest: str) -> set:
    """What finds every listed rest that is one code point away."""
    keys: set = _shorter(rest) if len(rest) <= LONG + 1 else set()
    for m in range(max(LONG + 1, len(rest) - 1), len(rest) + 2):
        keys |= {(FIRST, rest[: m // 2]), (LAST, rest[len(rest) - (m - m // 2) :])}
    return keys


class Shard:
    """The segments of some words, what is left of their owners, and an automaton."""

    def __init__(self) -> None:
        self.rests: dict[tuple[str, str], dict] = {}
        self.n: dict[str, int] = {}
        self.automaton = None

    def add(self, side: str, segment: str, word: str, n: int) -> None:
        rest = word[len(segment) :] if side == FIRST else word[: len(word) - len(segment)]
        of = self.rests.setdefault((side, segment), {})
        for key in owned_keys(rest):
            of.setdefault(key, []).append(word)
        self.n[word] = n

    def build(self) -> None:
        sides: dict[str, str] = {}
        for side, segment in self.rests:
            sides[segment] = sides.get(segment, "") + side
        self.automaton = ahocorasick.Automaton()
        for segment, both in sides.items():
            self.automaton.add_word(segment, (segment, both))
        self.automaton.make_automaton()

    def near(self, word: str) -> set[str]:
        """The owners near a word that this shard's segments show."""
        found: set[str] = set()
        if not self.rests:
            return found
        if self.automaton is None:
            self.build()
        for end, (segment, sides) in self.automaton.iter(word):
            start = end + 1 - len(segment)
            for side in sides:
                if start if side == FIRST else end + 1 < len(word):
                    continue
                rest = word[len(segment) :] if side == FIRST else word[:start]
                of = self.rests[side, segment]
                for key in asked_keys(rest):
                    for owner in of.get(key, ()):
                        # what a first half shows isn't counted again by the second one
                        if owner not in found and one_apart(owner, word) and (side == FIRST or not word.startswith(owner[: len(owner) // 2])):
                            found.add(owner)
        return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, a shard's owners before the words to be scanned."""
    at, shard = None, Shard()
    for batch in batches:
        rows: list[tuple] = []
        for key, owned, side, segment, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if key != at:
                at, shard = key, Shard()
            if owned:
                shard.add(side, segment, word, n)
            elif near := shard.near(word):
                most = max(shard.n[x] for x in near)
                rows.append((word, len(near), min(x for x in near if shard.n[x] == most), most))
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], ["word", "n_near", "best", "best_n"])


def near_words(words: DataFrame) -> DataFrame:
    """For each of `words` (word, n; distinct) that has near words: n_near, best (most frequent,
    ties to the smaller word) and best_n."""
    size, word = F.length("word"), F.col("word")
    k = F.floor(size / 2).cast("int")

    def segments(*pairs: Column) -> Column:
        return F.explode(F.array_distinct(F.array(*pairs)))

    def first(n: Column) -> Column:
        return F.struct(F.lit(FIRST).alias("side"), F.substring(word, F.lit(1), n).alias("segment"))

    def last(n: Column) -> Column:
        return F.struct(F.lit(LAST).alias("side"), F.substring(word, size - n + 1, n).alias("segment"))

    owners = words.select("word", "n", segments(first(k), last(size - k)).alias("s")).select("word", "n", "s.side", "s.segment")
    # halves of words one shorter, as long and one longer
    halves = [F.floor((size + d) / 2).cast("int") for d in (-1, 0, 1)]
    rests = [size + d - h for d, h in zip((-1, 0, 1), halves)]
    asking = words.select("word", segments(*map(first, halves), *map(last, rests)).alias("s")).select("word", "s.side", "s.segment")

    total = words.count()
    shards = max(1, 2 * total // SHARD)
    hot = checkpointed(owners.groupBy("side", "segment").agg(F.count("*").alias("owners")).where(F.col("owners") > HOT))
    hot = F.broadcast(hot.withColumn("rows", F.ceil(F.col("owners") / HOT)))
    plain = F.concat(F.lit("#"), F.pmod(F.xxhash64("side", "segment"), F.lit(shards)).cast("string"))
    deal = lambda axis: F.pmod(F.xxhash64("word", F.lit(axis)), F.col("rows"))
    every = F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)
    cell = lambda i, j: F.concat_ws("/", "side", "segment", i.cast("string"), j.cast("string"))
    own_cells = F.when(F.col("rows").isNull(), F.array(plain)).otherwise(F.transform(every, lambda j: cell(deal(0), j)))
    ask_cells = F.when(F.col("rows").isNull(), F.array(plain)).otherwise(F.transform(every, lambda i: cell(i, deal(1))))
    dealt = owners.join(hot, ["side", "segment"], "left").select(F.explode(own_cells).alias("shard"), F.lit(True).alias("owned"), "side", "segment", "word", "n")
    none = F.lit(None).cast("string")
    scanned = asking.join(hot, ["side", "segment"], "left").select(F.explode(ask_cells).alias("shard"), "word").distinct()
    scanned = scanned.select("shard", F.lit(False).alias("owned"), none.alias("side"), none.alias("segment"), "word", F.lit(None).cast("long").alias("n"))
    rows = dealt.unionByName(scanned).repartition("shard").sortWithinPartitions("shard", F.col("owned").desc())
    found = rows.mapInArrow(_scan, "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def variants(docs: DataFrame) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    words = checkpointed(word_counts(docs))
    joined = words.join(near_words(words), "word", "left")
    often = F.col("best_n") >= FACTOR * F.col("n")
    formed = checkpointed(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("best")).alias("form"), F.when(often, F.col("best_n")).alias("form_n")))
    steps = formed.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(JUMPS):
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        steps = checkpointed(steps.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return formed.join(steps, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
