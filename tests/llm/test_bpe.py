import struct

import public_tokenizers
from brute import sha
from tokenizers import Tokenizer

from predio.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
MORE = ["don't we'll", "a b　 c", "x y  z", " \n\n  \t1234abc١٢", "​﻿\x1c\x85 |", "é\U0001f600ß", "<|endoftext|><|endoftext|>", "a<|endoftext", "\x00"]


def test_equals_the_library(spark, odd, small):
    t = Tokenizer.from_file(PATH)
    more = spark.createDataFrame(list(enumerate(MORE)), "doc_id long, text string")
    for df in (odd, small, more):
        want = []
        for r in df.select("doc_id", "text").collect():
            ids = t.encode(r.text or "", add_special_tokens=False).ids
            want.append((r.doc_id, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(t.decode(ids, skip_special_tokens=False))))
        assert sorted(map(tuple, bpe.bpe_encode(df, PATH).collect()), key=str) == sorted(want, key=str)


def test_ids_and_texts(awkward, nothing):
    for r in bpe.bpe_encode(awkward, PATH, texts=True).collect():
        assert len(r.ids) == r.n_tokens and sha(r.decoded) == r.decoded_sha256
    assert bpe.bpe_encode(nothing, PATH).count() == 0
