from brute import kept_lines, sha

from predio.llm import line_dedup as L
from predio.llm.common import checkpointed as checkpoint


def expected(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    return sorted(((d, n, gone, sha(t)) for d, n, gone, t in kept_lines(rows)), key=str)


def got(df):
    return sorted((tuple(r)[:4] for r in L.line_dedup(df).collect()), key=str)


def test_equals_brute_force(awkward, odd, small):
    for df in (awkward, odd, small):
        assert got(df) == expected(df)


def test_texts_keep_columns(awkward, nothing):
    out = L.dedup_texts(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    texts = {d: t for d, _, _, t in kept_lines([(r.doc_id, r.text) for r in awkward.collect()])}
    for r in out.collect():
        assert (r.text or "") == texts[r.doc_id]
    assert L.dedup_texts(nothing).count() == 0 and L.line_dedup(nothing).count() == 0


def test_insert_and_delete_documents(awkward):
    even, rest = awkward.where("doc_id % 2 = 0"), awkward.where("doc_id % 2 = 1")
    before = L.reference_counts(L.postings(rest))
    both = L.insert_documents(before, even)
    assert sorted(both.collect()) == sorted(L.reference_counts(L.postings(awkward)).collect())
    assert sorted(L.delete_documents(both, even, rest).collect()) == sorted(before.collect())


def held(index):
    """What the filters let through, of all keys of the index."""
    keys = sorted((r.k1, r.k2) for r in index.counts.collect())
    found = set()
    for r in index.filters.collect():
        mine = [k for k in keys if (k[0] >> 40) % index.n_shards == r.shard]
        f = L.CuckooFilter.load(bytes(r["filter"]))
        found |= {k for k in mine if f.contains([k[0]], [k[1]])[0]}
    return found


def test_deleting_what_was_added_restores_the_index(awkward):
    even, rest = checkpoint(awkward.where("doc_id % 2 = 0")), checkpoint(awkward.where("doc_id % 2 = 1"))
    before = L.LineIndex.build(rest, n_shards=3)
    both = before.add(even)
    assert sorted(both.repeated.collect()) == sorted(L.LineIndex.build(awkward, n_shards=3).repeated.collect())
    out = sorted((tuple(r)[:4] for r in L.line_dedup(awkward, index=both).collect()), key=str)
    assert out == expected(awkward)
    back = both.delete(even, rest)
    assert sorted(back.counts.collect()) == sorted(before.counts.collect())
    assert {(r.k1, r.k2) for r in back.repeated.collect()} <= held(back) and len(held(back)) < len(held(both)) + 1
    assert sorted((tuple(r)[:4] for r in L.line_dedup(rest, index=back).collect()), key=str) == expected(rest)


def test_filters_lose_keys_that_leave_and_grow_when_full(spark):
    old = spark.createDataFrame([(i * 7919, i << 50) for i in range(8)], "k1 long, k2 long")
    new = spark.createDataFrame([(i * 7919, i << 50, True) for i in range(8, 60)], "k1 long, k2 long, enters boolean")
    all_keys = old.union(new.select("k1", "k2"))
    grown = L.update_filters(L.shard_filters(old, 1), new, all_keys, 1).collect()
    f = L.CuckooFilter.load(bytes(grown[0]["filter"]))
    assert len(grown) == 1 and f.table.size >= 60 and all(f.contains([i * 7919], [i << 50])[0] for i in range(60))
    leave = old.selectExpr("k1", "k2", "false enters")
    empty = L.CuckooFilter.load(bytes(L.update_filters(L.shard_filters(old, 1), leave, old.limit(0), 1).first()["filter"]))
    assert not empty.table.any() and not empty.over


def test_columns_with_names_of_its_own(spark):
    df = spark.createDataFrame([(1, "a", "x", 2), (2, None, "y", 3)], "doc_id long, text string, lost string, id int")
    assert sorted(map(str, L.dedup_texts(df).collect())) == sorted(map(str, df.collect()))


def test_full_filter_loses_nothing():
    f = L.CuckooFilter(2)
    for i in range(40):
        f.insert(i * 7919, i << 50)
    assert f.over and all(f.contains([i * 7919], [i << 50])[0] for i in range(40))
    assert all(f.delete(i * 7919, i << 50) for i in range(40)) and not f.table.any()
