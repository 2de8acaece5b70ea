from collections import defaultdict

import pytest
from brute import size, targets

from predio.llm import mixing as M


def test_targets_sizes_and_words(awkward, odd, small, nothing):
    for df in (awkward, odd, small):
        docs = df.select("doc_id", "text", "source").collect()
        sizes = defaultdict(int)
        for r in docs:
            sizes[r.source] += size(r.text)
        want, taken = targets(sizes), defaultdict(int)
        rows = M.assign(df).collect()
        assert len(rows) == len(docs)
        assert sorted(r["size"] for r in rows) == sorted(size(r.text) for r in docs)
        largest = defaultdict(int)
        for r in rows:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
            assert r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
            taken[r.source] += r.taken
            largest[r.source] = max(largest[r.source], r["size"])
        for s in sizes:
            assert abs(taken[s] - want[s]) <= largest[s]
        assert sorted(rows, key=str) == sorted(M.assign(df).collect(), key=str)
    assert M.assign(nothing).count() == 0 and M.mix(nothing).count() == 0


def test_mix_repeats_documents_and_keeps_columns(odd):
    out = M.mix(odd)
    assert out.columns == odd.columns
    assert out.count() == sum(r.copies for r in M.assign(odd).collect())


def test_positions_follow_the_schedule(spark):
    rows = [(i, "word " * 10, "abc"[i % 3]) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    at = M.assign(d).where("copies > 0").select("source", "position").toPandas()
    assert at["position"].between(0, 1).all()
    mean = at.groupby("source")["position"].mean()
    assert mean["a"] > 0.52 and mean["c"] < 0.48  # rising and falling weight


def test_position_inverts_the_integral(spark):
    from pyspark.sql import functions as F

    for k in (0.5, 0.0, -0.5):
        for t in (0.0, 0.3, 1.0):
            share = (1 - k) * t + k * t * t
            assert spark.range(1).select(M.position(F.lit(share), F.lit(k))).first()[0] == pytest.approx(t)


def test_no_python_on_the_main_path(awkward):
    plan = M.mix(awkward)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_columns_with_names_of_its_own(spark):
    df = spark.createDataFrame([(1, "a b", "x", 2, 5), (2, "c", "y", 3, 6)], "doc_id long, text string, source string, __id int, __n int")
    out = M.mix(df)
    assert out.columns == df.columns and {tuple(r) for r in out.collect()} <= {tuple(r) for r in df.collect()}
