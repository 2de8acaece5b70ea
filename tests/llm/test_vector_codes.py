import math
import random

import numpy as np
import pytest

from predio.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, text string"


def by_hand(rows, parts=16, entries=64, rounds=2, scale=256):
    """Plain loops over Python integers."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, [np.float32(x) for x in r[1]]))
    ints = [[math.floor(float(np.float32(x)) * scale) for x in r[1]] for r in kept]
    wide = len(ints[0]) // parts
    cut = [[tuple(v[p * wide : (p + 1) * wide]) for p in range(parts)] for v in ints]
    first = [c for r, c in zip(kept, cut) if r[0] is not None][:entries]  # rows without vec_id start no entry
    books = [[c[p] for c in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        found = [[min((far(c[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]
        if turn < rounds:
            for p in range(parts):
                for k in range(len(books[p])):
                    own = [c[p] for c, f in zip(cut, found) if f[p][1] == k]
                    if own:
                        books[p][k] = tuple(sum(x) // len(own) for x in zip(*own))
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for r, e in zip(kept, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    digest = V.books_sha256(np.array(books))
    return sorted(((r[0], "".join(f"{k:02x}" for _, k in f), e, by_label[r[2]], digest) for r, f, e in zip(kept, found, errors)), key=str)


def result(df, **options):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in V.compress(df, **options).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(2)
    centres = [[draw.gauss(0, 0.3) for _ in range(32)] for _ in range(9)]
    out = [(i * 3, [c + draw.gauss(0, 0.1) for c in centres[i % 9]], None if i % 4 == 0 else i % 3, "x") for i in range(150)]
    out += [out[5], out[5], (15, out[6][1], 1, "same id"), (None, out[7][1], 2, "no id"), (1, None, 0, "none"), (2, [], 0, "empty"), (4, [None] + out[0][1][1:], 0, "null"), (-1, [math.nan] + out[0][1][1:], 0, "nan"), (-2, [math.inf] + out[0][1][1:], 0, "inf")]
    return out + [(900 + i, [0.5 if j % 2 else -0.25 for j in range(32)], 1, "ties") for i in range(20)]


def test_equals_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for options in ({"parts": 8, "entries": 64, "rounds": 2}, {"parts": 4, "entries": 7, "rounds": 3}, {"parts": 1, "entries": 256, "rounds": 1}, {"parts": 32, "entries": 1, "rounds": 0}):
        assert result(df, **options) == by_hand(rows, **options)


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(120)
    assert result(df) == by_hand([(r.vec_id, r.embedding, r.label) for r in df.collect()])


def test_odd_lengths_and_sizes(spark, rows):
    more = [(5, [0.1] * 16, 1, "short"), (7, [1e30] + rows[0][1][1:], 77, "large"), (-9, [1e30] * 3, 1, "large and first")]
    got = result(spark.createDataFrame(rows + more, SCHEMA), parts=8)
    expected = by_hand(rows, parts=8)
    sums, digest = {r[3] for r in expected}, expected[0][4]
    plain = [r for r in got if r[1] is not None]
    assert plain == expected
    odd = {r[0]: r for r in got if r[1] is None}
    assert set(odd) == {5, 7, -9} and odd[7][3] is None and odd[5][3] in sums and all(r[2] is None and r[4] == digest for r in odd.values())


def test_nothing(spark, rows):
    for bad in ([], [(1, None, 1, "x"), (2, [math.nan], None, "x")]):
        assert result(spark.createDataFrame(bad, SCHEMA)) == []
    with pytest.raises(ValueError):
        V.compress(spark.createDataFrame(rows[:3], SCHEMA), parts=5)


def test_search_is_exact_and_short():
    draw = np.random.default_rng(4)
    book = draw.integers(-60, 60, (64, 4))
    book[10] = book[3]  # equal entries: the lower index wins
    points = np.concatenate([draw.integers(-60, 60, (3000, 4)), book])
    far = ((points[:, None] - book[None]) ** 2).sum(2)
    for start in (np.zeros(len(points), int), draw.integers(0, 64, len(points)), far.argmin(1)):
        best, least, asked = V.nearest(points, book, start)
        assert (best == far.argmin(1)).all() and (least == far.min(1)).all()
    assert asked < 0.5 * far.size
