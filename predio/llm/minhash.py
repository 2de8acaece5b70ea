"""Near-duplicates by SuperMinHash, banding, verification and union-find.

Signatures: each element of a document's set of shingles has a random permutation of the
slots; level j of an element offers the value j + r to the j-th slot of its permutation,
and a slot keeps the least value. A document is done at the first level after which all
its slots are filled, as later levels can't be less. The offers of one element are
correlated, which gives the estimate less variance than independent hashes.

Documents with equal sets are one class, represented by the smallest doc_id. Classes that
agree in a band meet in a bucket; the member that meets most others over all its bands is
the bucket's leader (the original of its copies, as a rule), and every member is compared
with its leader on full sets. What is left are pairs of which one
differs too much from the leader. Call what a member adds to its leader's n elements and
what it lacks of them its changes, d in number, and w = 4 * added + 5 * lacking. A member a
isn't linked with the leader if w_a > n, and a and b are linked only if 9 times the number
of their common changes is at least w_a + w_b - n. So each member's changes are ordered,
rarest in the leader's crowd first, and a prefix of them is enough to find every such pair:
b needs (w_b + 1) / 9 common changes at least, and a (w_a - n) / 5, as w_b is at least 4
times what is common. Where two prefixes meet, the changes still to come bound what can be
common; a row that no row of another component can match by that bound is dropped before rows
meet, so few pairs are formed; those are confirmed on full sets. Pairs within a cluster
aren't listed: of the members that meet in a change, one that is apart from the leader
leads the others again, and only members that are still in different components after
`ROUNDS` such rounds are paired.

Links are joined to components by union-find within tasks and then by star contraction
over the tasks' results, until what is left is small enough for one task; nothing of it
goes through the driver.

Two sets of similarity 0.8 meet in no bucket with probability 3e-6 (252 slots, 42 bands
of 6), more similar ones less often.

Defined results: a text without words has an empty set and is linked with nothing; a text
of fewer words than a shingle has them as its one element; of rows with equal doc_id the
one with the smallest set digest stands for the document, which is returned once; rows
without doc_id are returned with a null component and kept; an empty table gives an empty
table; other columns are neither read nor returned by `near_duplicates`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from predio.llm.common import checkpointed

SLOTS, BANDS = 252, 42
SHINGLE = 5
THRESHOLD = (4, 5)
#: Rounds of new leaders before the members left are paired; they save pairs, the result is the same.
ROUNDS = 1
#: Members that meet in one change from which a new leader is worth its comparisons; fewer are paired at once.
LONG = 32
#: A key with more than the SPREADth part of a table's rows is dealt over SPREAD tasks; there are fewer than SPREAD such keys.
SPREAD = 64
#: Pairs up to which their members' ids are broadcast, at 32 bytes each.
FEW = 100_000
#: Edges up to which one task's union-find ends the joining of components (a few dozen MB).
LAST_EDGES = 250_000
#: Bytes of text, and elements with a permutation each, that a task works on at a time.
PIECE, ELEMENTS = 1 << 21, 60_000
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_draw = np.random.default_rng(11)
BYTE = _draw.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.ones(max(1, n), np.uint64)
    out[1:] = BASE
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts (A-Z in lower case), and each word's text."""
    data = np.frombuffer(b"\n".join(texts).translate(LOWER), np.uint8)
    inside = ~BLANK[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(inside)
    size = end - start
    first = np.cumsum(size) - size
    place = np.arange(len(at)) - np.repeat(first, size)
    terms = BYTE[data[at]] * _powers(int(size.max()))[place]
    hashes = mix(np.add.reduceat(terms, first) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(text_ends, start, side="right")


def shingle_sets(texts: list[str | None], width: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's set of shingles."""
    at = 0
    raw = [(t or "").encode() for t in texts]
    while at < len(raw):
        stop, size = at, 0
        while stop < len(raw) and (stop == at or size + len(raw[stop]) <= PIECE):
            size += len(raw[stop])
            stop += 1
        hashes, text = word_hashes(raw[at:stop])
        bounds = np.searchsorted(text, np.arange(stop - at + 1))
        for i in range(stop - at):
            words = hashes[bounds[i] : bounds[i + 1]]
            n = max(1, len(words) - width + 1)
            if not len(words):
                yield np.zeros(0, np.uint64)
                continue
            total = np.zeros(n, np.uint64)
            for k in range(min(width, len(words))):
                total = mix(total + words[k : k + n] + np.uint64(k + 1))
            yield np.unique(total)
        at = stop


def superminhash(sets: list[np.ndarray]) -> np.ndarray:
    """Signatures, one row of SLOTS values per set; sets may not be empty."""
    out = np.full((len(sets), SLOTS), NONE, np.uint64)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    item = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = None
    for j in range(SLOTS):
        x = mix(item + np.uint64((j + 1) * int(BASE) & 0xFFFFFFFFFFFFFFFF))
        k = j + ((x & np.uint64(0xFFFF)) * np.uint64(SLOTS - j) >> np.uint64(16)).astype(np.int64)
        if order is None:
            slot = k
        else:
            rows = np.arange(len(item))
            slot = order[rows, k].astype(np.int64)
            order[rows, k] = order[:, j]
        np.minimum.at(flat, owner * SLOTS + slot, np.uint64(j) << np.uint64(48) | x >> np.uint64(16))
        open_sets = (out == NONE).any(1)
        if not open_sets.any():
            break
        stay = open_sets[owner]
        if order is None:
            item, owner, k = item[stay], owner[stay], k[stay]
            order = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(item), 1))
            order[np.arange(len(item)), k] = 0
        elif not stay.all():
            item, owner, order = item[stay], owner[stay], order[stay]
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature; the band's number is part of it."""
    rows = SLOTS // BANDS
    parts = signatures.reshape(len(signatures), BANDS, rows)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * BASE, parts.shape[:2]).copy()
    for r in range(rows):
        key = mix(key + parts[:, :, r])
    return key.view(np.int64)


def signatures(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (digest of the set), bands array<long> (empty for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, digests, bands = [], [], []
            group: list[np.ndarray] = []

            def close() -> None:
                held = [s for s in group if len(s)]
                keys = iter(band_keys(superminhash(held)) if held else ())
                bands.extend(next(keys) if len(s) else [] for s in group)
                group.clear()

            for s in shingle_sets(batch.column(1).to_pylist(), width):
                size.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                group.append(s)
                if sum(map(len, group)) > ELEMENTS:
                    close()
            close()
            s = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "s1", "s2", "bands"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>")


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of sorted a: whether each is in sorted b."""
    if not len(b):
        return np.zeros(len(a), bool)
    at = np.searchsorted(b, a)
    return b[np.minimum(at, len(b) - 1)] == a


def _u64(x) -> np.ndarray:
    return np.frombuffer(x.as_py(), np.uint64)


def _linked(inter: int, n_a: int, n_b: int) -> bool:
    num, den = THRESHOLD
    return den * inter >= num * (n_a + n_b - inter)


def sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """id, items (the sorted set, packed) of the documents in ids: id, s1, s2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(3).to_pylist(), width))
            digests = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
            right = (digests[:, 0] == batch.column(1).to_numpy()) & (digests[:, 1] == batch.column(2).to_numpy())
            at = np.flatnonzero(right)  # another row with the same doc_id isn't it
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([sets[i].tobytes() for i in at.tolist()], pa.binary())], ["id", "items"])

    d = docs.selectExpr("cast(doc_id as long) __doc", "text")
    return d.join(ids, F.col("__doc") == F.col("id")).select("id", "s1", "s2", "text").mapInArrow(run, "id long, items binary").dropDuplicates(["id"])


COMPARED = "lead long, member long, n_lead long, n_member long, linked boolean, plus binary, minus binary"


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], total: int) -> DataFrame:
    """big joined with small, which has one row per key and its number `n` of rows in big
    (of `total`, about); frequent keys are salted. n isn't returned."""
    often = F.col("n") * SPREAD > total
    hot = small.where(often).select(*keys, F.lit(True).alias("__hot"))  # fewer than SPREAD rows
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*big.columns), F.lit(SPREAD))).otherwise(F.lit(0).cast("long"))
    dealt = big.join(F.broadcast(hot), keys, "left").withColumn("__salt", salt).drop("__hot")
    copies = F.explode(F.when(often, F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))
    return dealt.join(small.withColumn("__salt", copies).drop("n"), [*keys, "__salt"]).drop("__salt")


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (lead, member) with what the member adds to its leader's set and lacks of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = _u64(a), _u64(b)
                plus, minus = b[~_shared(b, a)], a[~_shared(a, b)]
                rows.append((len(a), len(b), _linked(len(b) - len(plus), len(a), len(b)), plus.tobytes(), minus.tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
            cols = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["lead", "member", "n_lead", "n_member", "linked", "plus", "minus"])

    members = sets.select(F.col("id").alias("member"), F.col("items").alias("member_items"))
    crowd = pairs.groupBy("lead").agg(F.count("*").alias("n"))
    leads = crowd.join(sets.select(F.col("id").alias("lead"), F.col("items").alias("lead_items")), "lead")
    both = spread_join(pairs.join(members, "member"), leads, ["lead"], pairs.count())
    return both.select("lead", "member", "lead_items", "member_items").mapInArrow(run, COMPARED)


def _worth_meeting(named: DataFrame, open_lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of the open lists that can be in a pair (those that are apart, and all), with `reach`,
    the largest w that a partner may have: 9 * (d - at) - w + n. A row stays only if a row of another
    component in its list is within its reach, so clusters that are near each other but not linked
    don't meet row by row."""
    rows = named.join(open_lists.select("lead", "item"), ["lead", "item"], "left_semi").withColumn("reach", 9 * (F.col("d") - F.col("at")) - F.col("w") + F.col("n"))
    per_component = rows.groupBy("lead", "item", "c").agg(F.min("w").alias("w"), F.min(F.when(F.col("apart"), F.col("w"))).alias("w_apart"))
    of = lambda w: F.min(F.when(F.col(w).isNotNull(), F.struct(F.col(w).alias("w"), "c")))
    least = per_component.groupBy("lead", "item").agg(of("w").alias("any"), of("w_apart").alias("apart_one"))
    other = lambda w, one: F.min(F.when(F.col("c") != F.col(f"{one}.c"), F.col(w)))
    second = per_component.join(least, ["lead", "item"]).groupBy("lead", "item").agg(F.first("any").alias("any"), F.first("apart_one").alias("apart_one"), other("w", "any").alias("any_other"), other("w_apart", "apart_one").alias("apart_other"))
    near = lambda one, rest: F.when(F.col("c") == F.col(f"{one}.c"), F.col(rest)).otherwise(F.col(f"{one}.w"))
    judged = checkpointed(rows.join(second, ["lead", "item"]).select(*rows.columns, (F.col("reach") >= near("any", "any_other")).alias("meets_any"), (F.col("reach") >= near("apart_one", "apart_other")).alias("meets_apart")).where("meets_any or meets_apart"))
    return judged.where("apart and meets_any"), judged.where("meets_apart")


def _between_members(compared: DataFrame) -> DataFrame:
    """Links (a, b) between members of one leader of which a isn't linked with it."""
    crowds = compared.groupBy("lead").agg(F.count("*").alias("n"), F.bool_or(~F.col("linked")).alias("apart")).where("n > 1 and apart").select("lead")
    crowd = compared.join(crowds, "lead", "left_semi")

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lead, member, plus, minus in zip(*(batch.column(c) for c in ("lead", "member", "plus", "minus"))):
                p, r = _u64(plus), _u64(minus)
                k = len(p) + len(r)
                if k:
                    found = pa.array(np.concatenate([p, mix(r + BASE)]).view(np.int64))  # lacking an element isn't adding it
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, lead.as_py())), found, pa.array(np.full(k, member.as_py()))], ["lead", "item", "member"])

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lead", "item", "member", "at", "d", "w", "n", "apart"]
        for batch in batches:
            for lead, member, n, plus, minus, few in zip(*(batch.column(c) for c in ("lead", "member", "n_lead", "plus", "minus", "few"))):
                p, r, n = _u64(plus), _u64(minus), n.as_py()
                d, w = len(p) + len(r), 4 * len(p) + 5 * len(r)
                often = {x["item"]: x["n"] for x in few.as_py() or ()}
                changes = np.concatenate([p, mix(r + BASE)]).view(np.int64)
                changes = changes[np.lexsort((changes, [often.get(x, 1) for x in changes.tolist()]))]
                need = -(-(w - n) // 5) if w > n else (w + 9) // 9
                stop = d - need + 1
                if stop > 0:
                    cols = [pa.array(np.full(stop, lead.as_py())), pa.array(changes[:stop]), pa.array(np.full(stop, member.as_py())), pa.array(np.arange(stop)), *[pa.array(np.full(stop, x)) for x in (d, w, n)], pa.array(np.full(stop, w > n))]
                    yield pa.RecordBatch.from_arrays(cols, names)

    each = crowd.select("lead", "member", "plus", "minus").mapInArrow(items, "lead long, item long, member long")
    counts = each.groupBy("lead", "item").agg(F.count("*").alias("n")).where("n > 1")
    shared = each.join(counts, ["lead", "item"]).groupBy("lead", "member").agg(F.collect_list(F.struct("item", "n")).alias("few"))  # at most a member's changes
    listed = crowd.join(shared, ["lead", "member"], "left").select("lead", "member", "n_lead", "plus", "minus", "few")
    prefixes = checkpointed(listed.mapInArrow(ordered, "lead long, item long, member long, at long, d long, w long, n long, apart boolean"))
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            good = []
            for n, n_a, n_b, pa_, ra, pb, rb in zip(*(batch.column(c) for c in ("n_lead", "n_a", "n_b", "plus_a", "minus_a", "plus_b", "minus_b"))):
                pa_, ra, pb, rb = _u64(pa_), _u64(ra), _u64(pb), _u64(rb)
                lacking = len(ra) + len(rb) - int(_shared(ra, rb).sum())
                good.append(_linked(n.as_py() - lacking + int(_shared(pa_, pb).sum()), n_a.as_py(), n_b.as_py()))
            keep = np.array(good, bool)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    def confirmed(pairs: DataFrame) -> DataFrame:
        one = checkpointed(pairs.select("lead", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        ids = one.select("lead", F.col("a").alias("member")).union(one.select("lead", "b")).distinct()
        needed = crowd.join(F.broadcast(ids) if one.count() <= FEW else ids, ["lead", "member"], "left_semi")
        side = lambda s: needed.select("lead", F.col("member").alias(s), "n_lead" if s == "a" else F.lit(0).alias("_"), F.col("n_member").alias(f"n_{s}"), F.col("plus").alias(f"plus_{s}"), F.col("minus").alias(f"minus_{s}"))
        return checkpointed(one.join(side("a"), ["lead", "a"]).join(side("b"), ["lead", "b"]).mapInArrow(confirm, "a long, b long"))

    known = compared.where("linked").select(F.col("lead").alias("a"), F.col("member").alias("b"))
    total = prefixes.count()
    found = [known.where("false")]
    label = components(known)
    for turn in range(ROUNDS + 1):
        named = prefixes.join(label.withColumnsRenamed({"id": "member", "component_id": "c"}), "member", "left").withColumn("c", F.coalesce("c", "member"))
        open_lists = named.groupBy("lead", "item").agg(
            F.count("*").alias("n"),
            F.min_by(F.struct("member", "c"), F.when(F.col("apart"), F.xxhash64("member", F.lit(turn)))).alias("head"),
            F.min("c").alias("low"), F.max("c").alias("high"),
        ).where("head is not null and low < high").select("lead", "item", "n", "head")
        open_lists = checkpointed(open_lists)
        if open_lists.isEmpty():
            break
        long = open_lists.where(F.col("n") > LONG)
        if turn < ROUNDS and not long.isEmpty():
            met = spread_join(named.select("lead", "item", "member", "c"), long, ["lead", "item"], total)
            stars = met.where("member <> head.member and c <> head.c").select("lead", F.col("head.member").alias("a"), F.col("member").alias("b"))
            found.append(confirmed(stars))
            if not found[-1].isEmpty():
                known = known.unionByName(found[-1])
                label = components(known)
                continue
        left, right = _worth_meeting(named, open_lists)
        left = left.select("lead", "item", F.col("member").alias("a"), F.col("c").alias("c_a"), F.col("w").alias("w_a"), F.col("reach").alias("reach_a"))
        right = right.select("lead", "item", F.col("member").alias("b"), F.col("c").alias("c_b"), F.col("w").alias("w_b"), F.col("reach").alias("reach_b"))
        met = left.join(right, ["lead", "item"]).where("c_a <> c_b and w_b <= reach_a and w_a <= reach_b")
        found.append(confirmed(met.select("lead", "a", "b")))
        break
    return reduce(DataFrame.unionByName, found)


def links(docs: DataFrame, classes: DataFrame, width: int = SHINGLE) -> DataFrame:
    """Verified links (a, b), a < b, between classes: id, s1, s2, bands."""
    met = classes.select("id", F.explode("bands").alias("band"))
    rows = classes.count() * BANDS
    shared = met.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").withColumn("others", F.col("n"))
    met = checkpointed(spread_join(met, shared, ["band"], rows))
    rank = met.groupBy("id").agg(F.struct(F.sum("others").alias("n"), (-F.col("id")).alias("first")).alias("rank"))
    buckets = met.join(rank, "id").groupBy("band").agg(F.max("rank").alias("top"), F.count("*").alias("n")).select("band", (-F.col("top.first")).alias("lead"), "n")
    pairs = checkpointed(spread_join(met, buckets, ["band"], rows).where("id <> lead").select("lead", F.col("id").alias("member")).distinct())
    involved = pairs.select(F.col("lead").alias("id")).union(pairs.select("member")).distinct()
    sets = checkpointed(sets_of(docs, classes.select("id", "s1", "s2").join(involved, "id", "left_semi"), width))
    compared = checkpointed(_compare(pairs, sets))
    found = compared.where("linked").select(F.col("lead").alias("a"), F.col("member").alias("b"))
    return checkpointed(found.unionByName(_between_members(compared)).distinct())


def _local_unions(edges: DataFrame) -> DataFrame:
    """Union-find within each task: every node of its edges to the smallest it reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
        ends = [(x, root(x)) for x in parent]
        ends = [(r, x) for x, r in ends if x != r]
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.int64()) for k in (0, 1)], ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """id, component_id (smallest id reachable) of every node of the edges (a, b)."""
    state, before = checkpointed(_local_unions(edges).distinct()), None
    total = state.count()
    while total > LAST_EDGES:
        # large star: larger neighbours go to the smallest of the neighbourhood; small star: the rest does
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n"))
        large = spread_join(both.where("b > a"), least, ["a"], total).select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        state = checkpointed(small)
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return state.select(F.col("b").alias("id"), F.col("a").alias("component_id"))
        before, total = now, now[0]
    last = checkpointed(_local_unions(state.coalesce(1)))
    return last.select(F.col("b").alias("id"), F.col("a").alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    signed = checkpointed(signatures(docs, width))
    one = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("s1", "s2", "n_shingles", "bands")).alias("r")).select("doc_id", "r.*")
    classes = one.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("id"))
    bands = one.select(F.col("doc_id").alias("id"), "bands")
    classes = checkpointed(classes.join(bands, "id"))
    groups = components(links(docs, classes, width))
    of_class = classes.select("s1", "s2", "id").join(groups, "id", "left").select("s1", "s2", F.coalesce("component_id", "id").alias("c"))
    found = one.join(of_class, ["s1", "s2"], "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.coalesce("c", "doc_id")).otherwise(F.col("doc_id")))
    found = found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    nameless = signed.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return found.unionByName(nameless)


def drop_near_duplicates(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """The documents that are the smallest of their component, in the columns of docs. Rows
    with equal doc_id are one document: they stay or go together."""
    kept = near_duplicates(docs, width).where("kept").select(F.col("doc_id").alias("__kept_id"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__kept_id"]), "left_semi")
