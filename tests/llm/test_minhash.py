import random

import numpy as np
import pytest
from brute import components, shingles
from pyspark.sql import functions as F

from predio.llm import minhash as N


def got(df, width):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df, width).collect()}


@pytest.mark.parametrize("width", [2, 5])
def test_equals_brute_force(awkward, small, width):
    for df in (awkward, small):
        assert got(df, width) == components([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], width)


def test_chains_and_members_far_from_their_leader(spark, monkeypatch):
    monkeypatch.setattr(N, "LAST_EDGES", 0)
    draw = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for g in range(12):
        base = [draw.choice(words) for _ in range(draw.choice([12, 40, 150]))]
        for _ in range(14):
            copy = list(base)
            for _ in range(draw.randrange(0, max(2, len(base) // 8))):
                at = draw.randrange(len(copy))
                copy[at : at + draw.randrange(0, 2)] = [draw.choice(words)] * draw.randrange(0, 3)
            rows.append((len(rows) * 3 + 1, " ".join(copy)))
            if draw.random() < 0.3:
                base = copy  # drifts
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for width in (2, 5):
        assert got(df, width) == components(rows, width)


def test_odd_rows_and_nothing(odd, nothing):
    out = N.near_duplicates(odd, 2).collect()
    assert sum(r.doc_id is None for r in out) == 2 and all(r.kept for r in out if r.doc_id is None)
    named = [r.doc_id for r in out if r.doc_id is not None]
    assert len(named) == len(set(named))
    assert N.near_duplicates(nothing, 2).count() == 0 and N.drop_near_duplicates(nothing).count() == 0


def test_one_of_each_group_stays(awkward):
    out = N.drop_near_duplicates(awkward)
    want = {d for d, (_, _, kept) in components([(r.doc_id, r.text) for r in awkward.collect()], 5).items() if kept}
    assert out.columns == awkward.columns and {r.doc_id for r in out.collect()} == want


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(1)
    a = draw.integers(0, 1 << 63, 400, dtype=np.uint64)
    b = np.concatenate([a[:300], draw.integers(0, 1 << 63, 100, dtype=np.uint64)])
    s = N.superminhash([np.unique(a), np.unique(b), np.unique(a)[:3]])
    assert abs((s[0] == s[1]).mean() - 300 / 500) < 0.1 and (s != N.NONE).all()


def test_sets_have_the_right_size():
    for text in ("", "a", "A b a B a b", "x y z"):
        for width in (2, 5):
            assert len(next(N.shingle_sets([text], width))) == len(shingles(text, width))


def test_links_within_a_cluster_grow_in_proportion(spark):
    """Two clusters, 0.74 alike: the second one's members are apart from the first one's leader."""
    counts = {}
    for n in (40, 160):
        draw = random.Random(5)
        first = [f"a{i}" for i in range(200)]
        second = first[:170] + [f"b{i}" for i in range(30)]
        rows = []
        for k in range(2 * n):
            words = list(first if k % 3 else second) if k else list(first)
            for _ in range(3):
                words[draw.randrange(160)] = f"x{draw.randrange(10_000)}"
            rows.append((k, " ".join(words)))
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
        if n == 160:
            assert got(df, 1) == components(rows, 1)
        signed = N.signatures(df, 1)
        classes = signed.groupBy("s1", "s2").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"))
        counts[n] = N.links(df, classes, 1).count()
    assert counts[160] < 8 * counts[40]  # 16 times, if each pair had a link


def test_near_but_unlinked_clusters_meet_in_proportion(spark, monkeypatch):
    """Three clusters 0.76 to 0.77 alike: what is joined row by row grows with the documents, not their square."""
    joined = []
    plain = N._worth_meeting

    def counted(*args):
        left, right = plain(*args)
        a, b = (x.groupBy("lead", "item").agg(F.count("*").alias(n)) for x, n in ((left, "a"), (right, "b")))
        joined.append(a.join(b, ["lead", "item"]).agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0))).first()[0])
        return left, right

    monkeypatch.setattr(N, "_worth_meeting", counted)
    found = {}
    for n in (20, 80):
        draw = random.Random(7)
        bases = [[f"w{i}" for i in range(174)] + [f"{c}{i}" for i in range(26)] for c in "abc"]
        rows = []
        for k in range(3 * n):
            words = list(bases[k % 3])
            if k >= 3:
                words[draw.randrange(174)] = f"x{draw.randrange(10_000)}"
            rows.append((k, " ".join(words)))
        joined.clear()
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
        assert got(df, 1) == components(rows, 1)
        found[n] = sum(joined)
    assert found[80] <= 8 * max(found[20], 3 * 20)  # 16 times, if members met each other


def test_a_band_that_many_documents_share(spark, monkeypatch):
    """Frequent bands are dealt over tasks; the result is the same."""
    monkeypatch.setattr(N, "SPREAD", 4)
    draw = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(120):
        words = list(base) if k % 3 else [f"y{draw.randrange(9999)}" for _ in range(150)]
        words[draw.randrange(150)] = f"x{k}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(df, 2) == components(rows, 2)
