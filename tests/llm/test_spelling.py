import random
import re
import zlib
from collections import Counter

import pytest

from predio.llm import spelling as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(docs):
    total = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 7:
                total[run] += 1
    return near_by_hand({w: n for w, n in total.items() if n >= 2})


def apart(a, b):
    """Edit distance by the whole table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, before = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(before[j] + (x != y), before[j + 1] + 1, row[j] + 1))
    return row[-1] == 1


def near_by_hand(words):
    out = {}
    for w, n in words.items():
        near = [x for x in words if abs(len(x) - len(w)) < 2 and apart(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 10 * n else None
        out[w] = [n, len(near), form, words[form] if form else None]
    for w in out:
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w].append(root)
    return {w: tuple(x) for w, x in out.items()}


def result(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in S.variants(df).collect()}


@pytest.fixture(scope="module")
def chained(spark):
    draw, texts = random.Random(5), []
    counts = {"gobernar": 2500, "gobernart": 250, "gobernarte": 25, "gobernarten": 2, "xobernar": 240, "GOBERNÄR": 3, "éàüöçñâ": 30, "éàüöçñ": 40, "éàüöçñâx": 2}
    counts |= {"a" * 6 + c: 4 for c in "abcdefg"} | {"q" * k: 3 for k in range(7, 12)} | {"z" * 90 + "abc": 30, "z" * 90 + "abd": 2, "z" * 91 + "abc": 2, "z" * 45 + "y" + "z" * 44 + "abc": 2}
    every = [w for w, n in counts.items() for _ in range(n)]
    draw.shuffle(every)
    while every:
        k = draw.randint(1, 60)
        texts.append(" ".join(every[:k]))
        every = every[k:]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "gobernar gobernar"), (None, None), (3, ""), (3, "gobernar 1gobernar2")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_equals_brute_force(chained):
    rows, df = chained
    expected = by_hand(rows)
    assert result(df) == expected
    assert expected["gobernarte"][4] == "gobernar" and any(x[4] != x[2] for x in expected.values() if x[2])


def test_awkward(awkward, odd, nothing):
    for df in (awkward, odd, nothing):
        assert result(df) == by_hand([(r.doc_id, r.text) for r in df.collect()])


def test_small_shards_and_hot_segments(chained, small, monkeypatch):
    rows, df = chained
    for name, value in (("SHARD", 10), ("HOT", 2), ("COUNTED", 50), ("LONG", 3)):
        monkeypatch.setattr(S, name, value)
    assert result(df) == by_hand(rows)


def test_one_segment_of_many_words(spark):
    """All words share their first half: the owners are dealt over a grid."""
    letters = "abcdefghijklmnop"
    words = {f"compa{a}{b}{c}": 2 + (a == b) * 40 for a in letters for b in letters for c in "xyz"}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    expected = near_by_hand(words)
    S_hot, S.HOT = S.HOT, 100
    try:
        got = {r.word: (r.n_near, r.best) for r in S.near_words(df).collect()}
    finally:
        S.HOT = S_hot
    assert {w: x[0] for w, x in got.items()} == {w: x[1] for w, x in expected.items() if x[1]}
    assert all(got[w][1] == x[2] for w, x in expected.items() if x[2])


def test_distance():
    for a, b, yes in (("abc", "abc", False), ("abc", "abd", True), ("abc", "ab", True), ("abc", "xabc", True), ("abc", "acb", False), ("aab", "ab", True), ("abc", "abcde", False)):
        assert S.one_apart(a, b) is yes and S.one_apart(b, a) is yes
