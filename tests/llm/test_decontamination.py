import random
import re
from collections import Counter

import pytest

from predio.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def by_hand(docs, items, width=10, near=20):
    phrases = {}
    for item, text in items:
        ws = words(text)
        for i in range(max(1, len(ws) - width + 1) if ws else 0):
            phrases.setdefault(tuple(ws[i : i + width]), set()).add("" if item is None else str(item))
    counts = Counter(w for _, t in docs for w in words(t))
    for doc_id, text in docs:
        ws, hit, ids, close = words(text), set(), set(), set()
        at = {}
        for i, w in enumerate(ws):
            at.setdefault(w, []).append(i)
        for p, of in phrases.items():
            for i in at.get(p[0], ()):
                if tuple(ws[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    ids |= of
            if all(counts[w] for w in p):
                a, *rest = sorted(set(p), key=lambda w: (counts[w], w))
                if a in at and (not rest or any(abs(i - j) <= near for i in at[a] for j in at.get(rest[0], ()))):
                    close |= of
        yield doc_id, len(ws), len(hit), len(ids), ",".join(sorted(ids)), bool(hit), ",".join(sorted(close))


def result(docs, items):
    out = D.decontaminate(docs, items).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated, ",".join(r.near_items)) for r in out), key=str)


def check(docs, items):
    expected = by_hand([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = result(docs, items)
    assert got == sorted(expected, key=str)
    return got


@pytest.fixture(scope="module")
def planted(spark):
    draw = random.Random(8)
    vocabulary = [f"{a}{b}" for a in "ka le mi to su ré ñu".split() for b in "bcdfg"] + ["the", "of"] * 20
    prose = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    items = [prose(draw.randint(10, 30)) for _ in range(20)] + [["the"], ["of", "the", "of"], ["The"] * 12, [], prose(9)]
    items.append(items[0])  # one passage in two items
    docs = []
    for i in range(120):
        ws = prose(draw.randint(0, 150))
        for _ in range(i % 3):
            item = draw.choice(items)
            at, k = draw.randint(0, len(ws)), draw.randint(0, max(0, len(item) - 9))
            ws[at:at] = item[k : k + draw.randint(8, 14)]
        docs.append((i % 100, draw.choice((" ", ", ", "\n-")).join(ws).title() if i % 5 else " ".join(ws)))
    docs += [(None, " ".join(items[3])), (None, None), (7, " ".join(items[4])), (7, " ".join(items[4])), (500, " ".join(items[5] * 60)), (501, "the " * 3000)]
    rows = [(n, " ".join(ws)) for n, ws in enumerate(items)] + [(2, "kab kac"), (None, " ".join(prose(12))), (99, None)]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(rows, "item_id long, text string")


def test_equals_brute_force(planted):
    got = check(*planted)
    assert len({r[4] for r in got}) > 20 and any(not r[5] for r in got) and any(r[4] != r[6] for r in got)


def test_shuffled_when_the_benchmark_is_large(planted, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST", 0)
    check(*planted)


def test_awkward(awkward, odd, nothing, spark):
    items = spark.createDataFrame([("b", "this very line stands in many documents and is over forty"), ("a", "日本語 の"), ("c", "one"), ("", "ab ab"), ("d", "WORDS in capitals words in capitals words in capitals words")], "item_id string, text string")
    for docs in (awkward, odd):
        assert any(r[2] for r in check(docs, items))
    assert result(nothing, items) == []
    none = items.where("false")
    assert all(not r[5] and r[3] == 0 for r in check(awkward, none))


def test_spans_and_plan(spark):
    docs = spark.createDataFrame([(1, "x a b c d e f g h i j k y a b c d e f g h i j")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "q r s")], "item_id long, text string")
    out = D.decontaminate(docs, items)
    row = out.first()
    assert [tuple(s) for s in row.spans] == [(1, 11), (2, 12), (13, 23)] and row.n_hit == 21 and row["items"] == ["1"]
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
