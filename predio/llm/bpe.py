"""Byte-level BPE encoding and decoding.

Merging: every adjacent pair that has a merge rank stands in a priority queue; the
symbols form a doubly linked list. The lowest rank is taken first (leftmost on a tie);
an entry whose symbols have meanwhile merged is stale and skipped. Decoding joins the
vocabulary's byte strings.

The vocabulary file is a parameter. It is read on the driver and broadcast: its size is
fixed by the tokenizer, not by the data.

Defined results: a null text is the empty text; an empty text has no tokens; repeated
rows give repeated results; a null doc_id is carried along; an empty table gives an empty
table; other columns of the input are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Chunks kept per Python worker with their ids; the cache is emptied beyond that.
CACHE_ENTRIES = 400_000
CACHE_LENGTH = 48
#: The pre-tokenizer's pattern, white space by its Unicode property.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+|"
    r" ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: A chunk is a run without white space and one blank before it, or a run of white space. The
#: pattern never matches across a chunk's end, so chunks can be encoded one by one.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNKS = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def byte_symbols() -> dict[int, str]:
    """How byte-level vocabularies spell each byte: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoded(dict):
    """Chunk to its ids, packed; encodes what it doesn't hold."""

    def __init__(self, coder: ByteBPE):
        self.coder = coder

    def __missing__(self, chunk: str) -> bytes:
        got = b"".join(i.to_bytes(4, "little") for piece in self.coder.pieces.findall(chunk) for i in self.coder.merge_piece(piece.encode()))
        if len(chunk) <= CACHE_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = got
        return got


class ByteBPE:
    """Encoder and decoder of one vocabulary, given as the tokenizer's JSON text."""

    def __init__(self, spec: str):
        found = json.loads(spec)
        vocab, merges = found["model"]["vocab"], found["model"]["merges"]
        of_symbol = {s: b for b, s in byte_symbols().items()}
        self.bytes_of = {i: bytes(of_symbol[c] for c in s) for s, i in vocab.items()}
        self.start = [vocab[s] for _, s in sorted(byte_symbols().items())]
        self.merge = {}
        for rank, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.special = {t["content"]: t["id"] for t in found.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces = regex.compile(PATTERN)
        self.cache = Encoded(self)

    def merge_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece of text."""
        ids = [self.start[b] for b in piece]
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            if found := self.merge.get((ids[i], ids[i + 1])):
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, a, b, new = heapq.heappop(queue)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # stale
            ids[i], ids[j] = new, -1
            right[i] = after = right[j]
            if after >= 0:
                left[after] = i
                if found := self.merge.get((new, ids[after])):
                    heapq.heappush(queue, (found[0], i, new, ids[after], found[1]))
            if (before := left[i]) >= 0 and (found := self.merge.get((ids[before], new))):
                heapq.heappush(queue, (found[0], before, ids[before], new, found[1]))
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers. Special tokens in the
        text become their ids."""
        ids = self.cache.__getitem__
        if not any(s in text for s in self.special):
            return b"".join(map(ids, CHUNKS.findall(text)))
        out, at = [], 0
        for m in self.split.finditer(text):
            out += map(ids, CHUNKS.findall(text[at : m.start()]))
            out.append(self.special[m[0]].to_bytes(4, "little"))
            at = m.end()
        out += map(ids, CHUNKS.findall(text[at:]))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


_loaded: dict[int, ByteBPE] = {}


def _coder(spec: str) -> ByteBPE:
    """One coder for each Python worker and vocabulary."""
    key = hash(spec)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteBPE(spec)
    return _loaded[key]


def bpe_encode(docs: DataFrame, tokenizer_path: str, texts: bool = False) -> DataFrame:
    """One row per document: token count, digests of the ids and of the decoded text.

    texts=True adds the ids (array<int>) and the decoded text themselves.
    """
    spec = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(spec.value)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = coder.encode(text.as_py() or "")
                decoded = coder.decode(ids)
                row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                rows.append((*row, decoded, ids) if texts else row)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string()]
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "decoded", "ids"]
            columns = list(zip(*rows)) if rows else [()] * (5 if texts else 3)
            cols = [pa.array(x, k) for x, k in zip(columns[:4], kinds)]
            if texts:
                ends = np.cumsum([0, *columns[0]], dtype=np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(columns[4]), np.int32))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", *names[: len(cols)]])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA + (", decoded string, ids array<int>" if texts else ""))
