import numpy as np
import pytest
from brute import sha

from predio.llm import fingerprint as P


def by_hand(df):
    rows = sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        a, b, c = (P.fingerprint(x) for x in (t, edited, after))
        out.append((d, len(t), sha(edited), a, b, P.likeness([a], [b])[0], P.likeness([a], [c])[0]))
    return sorted(out, key=str)


def test_equals_one_by_one(awkward, odd, small):
    for df in (awkward, odd, small, small.limit(1)):
        df = df.cache()
        assert sorted(map(tuple, P.fingerprints(df).collect()), key=str) == by_hand(df)


def test_nothing(nothing):
    assert P.fingerprints(nothing).count() == 0


def test_buckets_by_brute_force():
    data = "some Text, ünd more".encode()
    counts = np.zeros(P.BUCKETS, int)
    for i in range(len(data) - 3):
        for k, (a, b, c) in enumerate(P.TRIPLETS):
            h = 0x27D4EB2F * (k + 1) + data[i + a] * 0x9E3779B1 + data[i + b] * 0x85EBCA77 + data[i + c] * 0xC2B2AE3D
            h &= 0xFFFFFFFF
            h = ((h ^ h >> 15) * 0x2C1B3C6D) & 0xFFFFFFFF
            counts[h >> 25] += 1
    assert (P.bucket_counts(data) == counts).all()


def test_likeness_orders_texts(small):
    out = P.fingerprints(small).toPandas()
    long = out[out["n_chars"] > 500]
    assert long["near_edited"].mean() > long["near_next"].mean() + 0.2
    assert ((out["near_edited"] >= 0) & (out["near_edited"] <= 1)).all()
    assert P.likeness([P.fingerprint("abc" * 40)], [P.fingerprint("abc" * 40)])[0] == pytest.approx(1)
