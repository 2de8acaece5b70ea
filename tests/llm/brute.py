"""Plain Python versions of the operators, one document at a time, for comparison."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

BLANK = "\t\n\x0b\x0c\r "
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def kept_lines(docs, min_chars=40, min_docs=5):
    """docs: list of (doc_id, text). Per document: lines, dropped lines, kept text."""
    key = lambda line: line.strip(BLANK).translate(LOWER)
    held = defaultdict(list)
    for i, (doc_id, text) in enumerate(docs):
        if doc_id is not None:
            for k in {key(x) for x in (text or "").split("\n")}:
                if len(k) >= min_chars:
                    held[k].append((doc_id, i))
    last = {k: max(v)[0] for k, v in held.items() if len(v) >= min_docs}
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        stay = [x for x in lines if doc_id is None or doc_id >= last.get(key(x), doc_id)]
        yield doc_id, len(lines), len(lines) - len(stay), "\n".join(stay)


def kept_bytes(docs, width=50):
    """Per document: bytes, removed bytes, removed runs, kept bytes."""
    first: dict[bytes, int] = {}
    data = [(d, (t or "").encode()) for d, t in docs]
    for d, b in data:
        if d is not None:
            for i in range(len(b) - width + 1):
                w = b[i : i + width]
                first[w] = min(d, first.get(w, d))
    for d, b in data:
        gone = bytearray(len(b))
        if d is not None:
            for i in range(len(b) - width + 1):
                if first[b[i : i + width]] < d:
                    gone[i : i + width] = b"\1" * width
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        yield d, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)


def rules(doc_id, text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    chars, dup = sum(map(len, words)), len(lines) - len(set(lines))
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    upper, letters = len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text))
    bad = 10 * symbols > len(words) or 2 * upper > letters or chars < 2 * len(words) or chars > 15 * len(words) or 10 * dup > 4 * len(lines)
    bullets = sum(bool(re.match(r"[\x20\x09-\x0D]*[-*+\u2022]", x)) for x in lines)
    cut = sum(x.rstrip(BLANK).endswith(("...", "\u2026")) for x in lines)
    bad = bad or 10 * bullets > 9 * len(lines) or 10 * cut > 3 * len(lines)
    return doc_id, len(words), chars, symbols, dup, len(covered), failed, not (failed or bad)


def size(text) -> int:
    return len(WORD.findall(text or ""))


def targets(sizes: dict, weights=(1, 2, 3), most=3) -> dict:
    """Water-filling: source -> target."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(most * sizes[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return share | {s: float(most * sizes[s]) for s in capped}
        capped |= over


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def components(docs, width):
    """docs: (doc_id, text), one row per doc_id -> doc_id, set size, component, kept."""
    sets = {d: shingles(t, width) for d, t in docs}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            s, t = sets[a], sets[b]
            if s and t and 5 * min(len(s), len(t)) >= 4 * max(len(s), len(t)) and 100 * len(s & t) >= 80 * len(s | t):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}
