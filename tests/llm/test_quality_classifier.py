import binascii

import numpy as np
import pytest

from predio.llm import quality_classifier as C


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = C.classify(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).join(labels, "doc_id").toPandas()
    assert (out["held_out"] == [binascii.crc32(str(i).encode()) % 5 == 0 for i in out["doc_id"]]).all()
    test = out[out["held_out"]]
    assert len(test) > 500 and ((test["score"] >= 0.3) == (test["predicted"] == 1)).all()
    ones, zeros = test["score"][test["quality"] == 1].to_numpy(), test["score"][test["quality"] == 0].to_numpy()
    auc = (ones[:, None] > zeros).mean() + (ones[:, None] == zeros).mean() / 2
    assert auc > 0.85 and (test["predicted"] == test["quality"]).mean() > 0.75


def test_held_out_labels_are_not_learnt_from(spark, small):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end quality")
    a, b = (sorted(map(tuple, C.classify(small, x).collect())) for x in (labels, turned))
    assert [r[:2] for r in a] == [r[:2] for r in b] and np.allclose([r[2] for r in a], [r[2] for r in b])


def test_isotonic():
    at, value = C.isotonic(np.array([1.0, 2.0, 3.0, 4.0]), np.array([0, 3, 1, 4]), np.array([4, 4, 4, 4]))
    assert value.tolist() == [0, 0.5, 1] and at.tolist() == [1, 2.5, 4]


def test_features_approximate_the_kernel():
    m = C.Model(np.zeros(len(C.STATS)), np.ones(len(C.STATS)))
    x = np.random.default_rng(1).normal(0, 1, (2, len(C.STATS)))
    f = m.features(x)[:, :-1]
    assert f[0] @ f[1] == pytest.approx(np.exp(-((x[0] - x[1]) ** 2).sum() / 2 / C.BANDWIDTH**2), abs=0.2)


def test_odd_rows_and_nothing(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (8, None, 0), (None, 1, 1), (15, 0, 1)], "doc_id long, quality int, toxic int")
    out = C.classify(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert all(r.score == 0.5 for r in C.classify(odd, labels.limit(0)).collect())
    assert C.classify(nothing, labels).count() == 0


def test_sums_give_what_one_direct_solve_gives(spark):
    """All scores again in one place: features one by one, ridge as least squares over stacked rows, and
    the best monotone steps by the minimum over the maximum of means."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r.score for r in C.classify(docs.repartition(7), labels).collect()}
    rows = {r.doc_id: np.array(C.statistics(r.text or "")) for r in docs.collect()}
    known = [(rows[r.doc_id], r.quality) for r in labels.collect() if r.quality is not None and binascii.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in rows]
    x, y = np.array([k[0] for k in known]), np.array([k[1] for k in known], float)
    draw = np.random.default_rng(C.SEED)
    turn, shift = draw.normal(0, 1 / C.BANDWIDTH, (x.shape[1], C.FEATURES)), draw.uniform(0, 2 * np.pi, C.FEATURES)
    mean, deviation = x.mean(0), x.std(0)
    deviation = np.where(deviation > 1e-9, deviation, 1.0)

    def features(s):
        z = np.clip((s - mean) / deviation, -8, 8)
        return np.append([np.sqrt(2 / C.FEATURES) * np.cos(sum(z[i] * turn[i, j] for i in range(len(z))) + shift[j]) for j in range(C.FEATURES)], 1.0)

    f = np.array([features(s) for s in x])
    size = f.shape[1]
    weight = np.sqrt(C.RIDGE * len(y) / size)
    w = np.linalg.lstsq(np.vstack([f, weight * np.eye(size)]), np.append(y, np.zeros(size)), rcond=None)[0]
    bins = np.clip(np.round((f @ w + 0.5) / 2 * C.BINS), 0, C.BINS).astype(int)
    at = np.unique(bins)
    ones, n = np.array([y[bins == b].sum() for b in at]), np.array([(bins == b).sum() for b in at])
    steps = np.array([max(min(ones[i : j + 1].sum() / n[i : j + 1].sum() for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))])
    place = at / C.BINS * 2 - 0.5
    middle = np.array([(place * n)[steps == v].sum() / n[steps == v].sum() for v in np.unique(steps)])
    for d in list(rows)[::7]:
        assert got[d] == pytest.approx(np.clip(np.interp(features(rows[d]) @ w, middle, np.unique(steps)), 0, 1), abs=2e-3)
