"""Benchmark decontamination by a distributed positional inverted index.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. A window is
`WINDOW` consecutive words of a benchmark item; an item of fewer, but not none, is one
window. Windows are known by their text, so equal passages of many items are one.

1. The benchmark's terms are counted over all documents.
2. Each window's terms are ordered by that count. Its two rarest ones, at fixed offsets,
   are its probe; windows that overlap share probes. A window with a term that no document
   has can't occur and is left out.
3. The index: one posting (document, term, position) for each occurrence of a term that some
   probe asks for, those of rarest terms with the words around them. It is written once
   and read by every step below.
4. The rarest term's postings meet the other term's of the same document within
   `NEAR` words, by blocks of positions, so that a posting meets a bounded number of others.
   Equal positions after the offset is taken off are phrase candidates, the rest proximity
   matches. The candidates' other terms are compared in the words around the posting.
5. Hits are gathered by document and set of items; covered words are counted by a fold
   over sorted spans.

The terms and probes of the benchmark are broadcast only up to `BROADCAST` rows each (a few
MB); a larger benchmark is joined by shuffles. All steps are DataFrame functions.

A document is its doc_id and two hashes of its text, so rows with equal doc_id are judged
each by its own text and equal rows get equal results. Defined results: a null or empty text
has no words and no hits; rows without doc_id are judged like others; a benchmark row
without text, or without words, has no window and is no item; rows with equal item_id are one
item; a null item_id counts as the empty string; without benchmark all documents are
clean; an empty table gives an empty table; other columns are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from predio.llm.common import checkpointed

WINDOW, NEAR = 10, 20
#: Positions to a block; as NEAR is not above it, only the blocks on both sides are of interest.
BLOCK = 32
#: Rows of a table made from the benchmark up to which it is broadcast (at most about 100 bytes each).
BROADCAST = 50_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["doc_id", "h1", "h2"]


def words(text: Column) -> Column:
    """The text's words in order; an empty array for a null text."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lower, SEPARATORS), "")


def _bounded(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few rows (counted, not guessed)."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """Distinct windows: phrase (words joined by blanks), ws, items (sorted array of ids)."""
    listed = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    cut = listed.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - width + 1)), lambda i: F.slice("ws", i, width))).alias("ws"))
    return cut.groupBy(F.array_join("ws", " ").alias("phrase"), "ws").agg(F.array_sort(F.collect_set("item")).alias("items"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """terms (one row each) with n, their occurrences in all documents; those without are left out."""
    every = docs.select(F.explode(words(F.col("text"))).alias("term"))
    few = terms.count() <= BROADCAST
    if few:
        return every.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("n"))
    return every.groupBy("term").agg(F.count("*").alias("n")).join(terms, "term")


def probes(found: DataFrame, counts: DataFrame) -> DataFrame:
    """windows with their rarest term `t1` at offset `o1` and the next rarest `t2` at `o2` (null if
    all words are equal). Ties go to the smaller term, repeated terms to their first place."""
    at = found.select("phrase", F.posexplode("ws").alias("o", "term")).groupBy("phrase", "term").agg(F.min("o").alias("o"))
    ranked = at.join(counts, "term").groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("n", "term", "o"))).alias("by"))
    whole = found.join(ranked, "phrase").where(F.size("by") == F.size(F.array_distinct("ws")))
    first, second = F.col("by")[0], F.get(F.col("by"), F.lit(1))
    return whole.select("phrase", "ws", "items", first["term"].alias("t1"), first["o"].alias("o1"), second["term"].alias("t2"), second["o"].alias("o2"))


def index(docs: DataFrame, terms: DataFrame, width: int = WINDOW) -> DataFrame:
    """Postings of `terms` (term, id, rare), written to the shared folder: KEY, id, pos and, for
    the rare ones, `around`: the words from width - 1 before to width - 1 after. One row per
    document with a null id has its number of words as pos."""
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"), words(F.col("text")).alias("ws"))
    ended = F.concat("ws", F.array(F.lit(None).cast("string")))
    rows = split.select(*KEY, "ws", F.posexplode(ended).alias("pos", "term"))
    listed = rows.join(_bounded(terms), "term", "left").where("id is not null or term is null")
    around = F.when(F.col("rare"), F.slice("ws", F.greatest(F.col("pos") - width + 2, F.lit(1)), F.least(F.col("pos"), F.lit(width - 1)) + width))
    return checkpointed(listed.select(*KEY, "id", "pos", around.alias("around")))


def matches(postings: DataFrame, pairs: DataFrame, near: int = NEAR) -> DataFrame:
    """Where a pair (id1, id2, gap) of terms stands in one document: KEY, pair, pos (of id1),
    around, exact (id2 at pos + gap). Pairs without id2 match wherever id1 stands."""
    lead = postings.where("around is not null").select(*KEY, F.col("id").alias("id1"), "pos", "around").join(pairs, "id1")
    alone = lead.where("id2 is null").select(*KEY, "pair", "pos", "around", F.lit(True).alias("exact"))
    place = (F.col("pos") / BLOCK).cast("int")
    asked = lead.where("id2 is not null").select(*KEY, F.col("id2").alias("id"), F.explode(F.array(place - 1, place, place + 1)).alias("block"), "pair", "gap", "pos", "around")
    other = postings.where("id is not null").groupBy(*KEY, "id", place.alias("block")).agg(F.collect_list("pos").alias("at"))
    same = asked["doc_id"].eqNullSafe(other["doc_id"])
    for k in ("h1", "h2", "id", "block"):
        same = same & (asked[k] == other[k])
    met = asked.join(other, same).select(*[asked[k] for k in KEY], "pair", "pos", "around", "gap", "at")
    close = met.where(F.exists("at", lambda x: F.abs(x - F.col("pos")) <= near))
    return close.select(*KEY, "pair", "pos", "around", F.array_contains("at", F.col("pos") + F.col("gap")).alias("exact")).unionByName(alone)


def covered(spans: Column) -> Column:
    """How many positions an array of spans (start, stop) covers."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach"))

    def add(got: Column, span: Column) -> Column:
        more = F.greatest(span["stop"] - F.greatest(span["start"], got["reach"]), F.lit(0))
        return F.struct((got["n"] + more).alias("n"), F.greatest(got["reach"], span["stop"]).alias("reach"))

    return F.aggregate(F.array_sort(spans), start, add, lambda got: got["n"])


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW, near: int = NEAR) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (sorted ids), spans
    (start, stop in words, of all occurring windows), contaminated, and near_items: ids of items
    with a window whose two rarest terms stand within `near` words of each other (phrase matches
    count)."""
    if near > BLOCK:
        raise ValueError(f"near is at most {BLOCK}")
    found = checkpointed(windows(items, width))
    terms = found.select(F.explode("ws").alias("term")).distinct()
    probed = checkpointed(probes(found, checkpointed(term_counts(docs, terms))))
    rare = probed.select(F.col("t1").alias("term"), F.lit(True).alias("rare"))
    wanted = rare.unionByName(probed.where("t2 is not null").select(F.col("t2").alias("term"), F.lit(False).alias("rare")))
    named = checkpointed(wanted.groupBy("term").agg(F.bool_or("rare").alias("rare")).withColumn("id", F.xxhash64("term")))
    postings = index(docs, named, width)

    pairs = probed.groupBy("t1", "t2", (F.col("o2") - F.col("o1")).alias("gap")).agg(F.collect_set(F.struct("o1", "ws", "items")).alias("windows"))
    pairs = pairs.select(F.xxhash64("t1").alias("id1"), F.when(F.col("t2").isNotNull(), F.xxhash64("t2")).alias("id2"), "gap", "windows")
    pairs = checkpointed(pairs.withColumn("pair", F.xxhash64("id1", "id2", "gap")))
    met = matches(postings, _bounded(pairs.drop("windows")), near)
    asked = pairs.select("pair", F.explode("windows").alias("w")).select("pair", "w.*", F.xxhash64("w.items").alias("set"))
    sets = checkpointed(asked.select("set", "items").distinct())
    start = F.col("pos") - F.col("o1")
    same = F.col("exact") & (start >= 0) & (F.slice("around", F.greatest(F.least("pos", F.lit(width - 1)) - F.col("o1") + 1, F.lit(1)), F.size("ws")) == F.col("ws"))
    span = F.when(same, F.struct(start.alias("start"), (start + F.size("ws")).alias("stop")))
    hits = met.join(_bounded(asked.drop("items")), "pair").groupBy(*KEY, "set").agg(F.collect_set(span).alias("spans"))
    of_doc = hits.join(_bounded(sets), "set").groupBy(*KEY).agg(
        F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.size("spans") > 0, F.col("items")))))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("near_items"),
    )
    whole = postings.where("id is null").select(*KEY, F.col("pos").cast("long").alias("n_words")).alias("d")
    of_doc = of_doc.alias("h")
    same_doc = F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.h1") == F.col("h.h1")) & (F.col("d.h2") == F.col("h.h2"))
    none = F.array().cast("array<string>")
    n_hit = F.coalesce(covered(F.col("spans")), F.lit(0))
    return whole.join(of_doc, same_doc, "left").select(
        "d.doc_id", "n_words", n_hit.alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"), F.array_sort(F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>"))).alias("spans"), (n_hit > 0).alias("contaminated"), F.coalesce("near_items", none).alias("near_items"),
    )
