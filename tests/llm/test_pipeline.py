import public_tokenizers
from brute import components, kept_lines, rules, size, targets
from tokenizers import Tokenizer

import corpus_pipeline
from predio.llm import mixing


def test_stages_against_brute_force(spark, awkward, small):
    """Each stage on what the one before kept."""
    docs = awkward.select(small.columns).unionByName(small.withColumn("doc_id", small["doc_id"] + 100_000)).cache()
    seen = docs.collect()
    rows = [(r.doc_id, r.text) for r in seen]

    a = corpus_pipeline.rules(spark, docs, "")
    want = {d: t for d, t in rows if rules(d, t)[-1]}
    assert {r.doc_id: r.text for r in a.collect()} == want

    b = corpus_pipeline.lines(spark, a, "")
    want = {d: t for d, _, _, t in kept_lines(list(want.items()))}
    got = b.collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got) and b.dtypes == docs.dtypes

    c = corpus_pipeline.near(spark, b, "").cache()
    kept = {d for d, (_, _, k) in components(list(want.items()), 5).items() if k}
    assert {r.doc_id for r in c.collect()} == kept

    d = corpus_pipeline.mixture(spark, c, "")
    times = {r.doc_id: r.copies for r in mixing.assign(c).collect()}
    sizes: dict = {}
    for r in c.collect():
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    want_words, words = targets(sizes), dict.fromkeys(sizes, 0)
    out = d.collect()
    for r in out:
        words[r.source] += size(r.text)
    assert len(out) == sum(times.values()) and d.dtypes == docs.dtypes
    assert all(abs(words[s] - want_words[s]) <= max(size(r.text) for r in c.collect() if r.source == s) for s in sizes)

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r, e in zip(sorted(out, key=lambda r: r.doc_id), corpus_pipeline.encoded(spark, d, "").orderBy("doc_id").collect()):
        assert r.doc_id == e.doc_id and t.encode(r.text or "", add_special_tokens=False).ids == list(e.ids)


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 50
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_empty_and_awkward_tables(spark, nothing, odd):
    docs = nothing
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.dtypes == nothing.dtypes and docs.count() == 0
    assert corpus_pipeline.encoded(spark, docs, "").count() == 0

    a = corpus_pipeline.rules(spark, odd, "").cache()
    assert a.dtypes == odd.dtypes and sorted((str(r.doc_id), r.text) for r in a.collect()) == sorted((str(r.doc_id), r.text) for r in odd.collect() if rules(r.doc_id, r.text)[-1])
    b = corpus_pipeline.lines(spark, a, "").cache()
    assert b.dtypes == odd.dtypes and b.count() == a.count()
    c = corpus_pipeline.near(spark, b, "").cache()
    ids = {r.doc_id for r in c.collect()}
    assert c.dtypes == odd.dtypes and 0 < len(ids) < len({r.doc_id for r in b.collect()})
    assert c.count() == sum(r.doc_id in ids for r in b.collect())
    d = corpus_pipeline.mixture(spark, c, "")
    assert d.dtypes == odd.dtypes and {r.doc_id for r in d.collect()} <= ids
    assert corpus_pipeline.encoded(spark, d, "").count() == d.count()
