import numpy as np
import pytest

from predio.llm import lm_score as L


def test_scores_word_by_word(small):
    """Sum of conditional log-probabilities, each worked out for itself."""
    words = L.vocabulary(L.word_counts(small))
    net = L.train(small, words)
    got = {r.doc_id: r for r in L.lm_score(small).collect()}
    for r in small.orderBy("n_chars").limit(30).collect():
        codes, total = words.codes(L.words_of(r.text))
        run = [0, 0, *words.classes[codes].tolist(), 0, 0]
        for i, code in enumerate(codes.tolist()):
            sides = [run[i], run[i + 1], run[i + 3], run[i + 4]]
            h = np.tanh(net.bias + sum(net.sides[k][s] for k, s in enumerate(sides)))
            z = (h @ net.out + net.base).astype(np.float64)
            total += z[run[i + 2]] - np.log(np.exp(z).sum()) + words.within[code]
        assert got[r.doc_id].n_tokens == len(codes) and got[r.doc_id].pseudo_logprob == pytest.approx(total, rel=1e-3, abs=1e-2)


def test_order_of_words_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    words = L.vocabulary(L.word_counts(docs))
    net = L.train(docs, words)
    draw, better, n = np.random.default_rng(2), 0, 0
    for r in docs.where("length(text) > 800").limit(60).collect():
        codes, _ = words.codes(L.words_of(r.text))
        classes = words.classes[codes]

        def score(c):
            sides, middle = L._contexts([c])
            return net.forward(sides)[1][np.arange(len(middle)), middle].sum()

        better += score(classes) > score(draw.permutation(classes))
        n += 1
    assert n == 60 and better >= 50


def test_counts_cover_all(odd):
    want: dict[bytes, int] = {}
    for r in odd.collect():
        for w in L.words_of(r.text):
            want[w] = want.get(w, 0) + 1
    assert {bytes(r.word): r.n for r in L.word_counts(odd).collect()} == want


def test_odd_rows_and_nothing(odd, nothing):
    out = L.lm_score(odd).collect()
    assert len(out) == odd.count()
    assert all((r.mean_logprob is None and r.pseudo_logprob == 0) if not r.n_tokens else r.pseudo_logprob < 0 for r in out)
    assert L.lm_score(nothing).count() == 0


def test_rare_words_have_their_own_probability(spark):
    """Beyond the head, a word's probability comes from its own count, and sums to one in each class."""
    rows = [(i, " ".join(f"w{j:05d}" for j in range(i, 9000, 3)) + " zzz9999" * (i + 1)) for i in range(3)]
    rows += [(10, "aaa0001 " * 3), (11, "aaa0002 " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = {bytes(r.word): r.n for r in L.word_counts(docs).collect()}
    words = L.vocabulary(L.word_counts(docs))
    outside = {w: n for w, n in counts.items() if w not in words.index}
    assert len(outside) == len(counts) - L.VOCABULARY > 900
    chance: dict[int, float] = {}
    for w, n in outside.items():
        code = len(words.index) + min(len(w) // 3, L.OTHER - 1)
        chance[code] = chance.get(code, 0) + n * np.exp(words.within[code])
    assert list(chance.values()) == [pytest.approx(1.0)] * len(chance)
    assert words.codes([min(outside)] * 2)[1] == pytest.approx(2 * np.log(outside[min(outside)]))


def test_classes_are_learned_from_what_stands_beside(spark):
    """Words of equal frequency that stand in different places come into different classes."""
    draw = np.random.default_rng(4)
    text = lambda: " ".join(f"the{draw.integers(12)} noun{draw.integers(200)} of{draw.integers(12)} verb{draw.integers(200)}" for _ in range(400))
    docs = spark.createDataFrame([(i, text()) for i in range(40)], "doc_id long, text string")
    words = L.vocabulary(L.word_counts(docs))
    L.train(docs, words)
    classes = lambda kind: {int(words.classes[i]) for w, i in words.index.items() if w.startswith(kind) and i >= L.ALONE}
    assert classes(b"noun") and classes(b"verb") and not classes(b"noun") & classes(b"verb")


def test_scores_do_not_depend_on_partitions(spark, small):
    """One model whatever the layout: few large tasks, or many small ones in another order."""
    docs = small.select("doc_id", "text")
    one, many = ({r.doc_id: r.mean_logprob for r in L.lm_score(d).collect()} for d in (docs.coalesce(1), docs.repartition(40, "text")))
    assert one == pytest.approx(many, rel=1e-4)


@pytest.mark.parametrize("common", [0, 300])
def test_counts_held_in_tasks_and_joined_counts_give_one_score(small, monkeypatch, common):
    """A word's count is the same whether it is looked up in the task or joined."""
    monkeypatch.setattr(L, "VOCABULARY", 100)
    want = {r.doc_id: r for r in L.lm_score(small).collect()}
    monkeypatch.setattr(L, "COMMON", common)
    words = L.vocabulary(L.word_counts(small))
    assert len(words.index) == 100 and (100 < len(words.place) <= common if common else len(words.place) == 100)
    got = {r.doc_id: r for r in L.lm_score(small).collect()}
    assert got.keys() == want.keys()
    assert all(r.n_tokens == want[k].n_tokens and r.pseudo_logprob == pytest.approx(want[k].pseudo_logprob, rel=1e-6) for k, r in got.items())


def test_common_words_are_no_rows_to_join(small, tmp_path):
    """Only words whose counts no task holds go through the shuffle; a small corpus has none."""
    rows = L.coded(small, L.vocabulary(L.word_counts(small)), str(tmp_path / "rows"))
    assert rows.count() == small.count()
    assert rows.selectExpr("sum(size(tail)) n").first().n == 0 < rows.selectExpr("sum(common) s").first().s


def test_a_round_reads_its_slice_alone(small, tmp_path):
    rows = L.coded(small, L.vocabulary(L.word_counts(small)), str(tmp_path / "rows"))
    some = rows.groupBy("slice").count().orderBy("slice").first()
    found = rows.where(f"slice = {some['slice']}").select("codes")
    assert found.count() == some["count"] < rows.count()
    read = {r.f for r in rows.selectExpr("input_file_name() f", "slice").where(f"slice = {some['slice']}").collect()}
    assert read and all(f"/slice={some['slice']}/" in f for f in read)
    assert "(slice#" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]


@pytest.mark.parametrize("size", [0.3, 40.0])
def test_chances_and_gradient_against_plain_softmax(size):
    """Also where a class's value is too large for exp in float32."""
    draw = np.random.default_rng(1)
    net = L.Network()
    net.load(np.concatenate([draw.normal(0, size if p is net.out else 0.5, p.size) for p in net.parts]))
    middle = draw.integers(1, L.CLASSES, 50).astype(np.uint8)
    sides = draw.integers(0, L.CLASSES, (2 * L.WINDOW, 50)).astype(np.uint8)
    h = np.tanh(sum(net.sides[k][s] for k, s in enumerate(sides)).astype(np.float64) + net.bias)
    z = h @ net.out.astype(np.float64) + net.base
    logs = z - z.max(1, keepdims=True)
    logs -= np.log(np.exp(logs).sum(1, keepdims=True))
    assert net.chances(sides, middle)[3] == pytest.approx(logs[np.arange(50), middle], rel=1e-3, abs=1e-3)
    g = np.exp(logs)
    g[np.arange(50), middle] -= 1
    back = (g @ net.out.T) * (1 - h * h)
    by_side = np.zeros(net.sides.shape)
    for k, s in enumerate(sides):
        np.add.at(by_side[k], s, back)
    want = np.concatenate([by_side.ravel(), back.sum(0), (h.T @ g).ravel(), g.sum(0)])
    assert net.gradient(sides, middle) == pytest.approx(want, rel=1e-3, abs=1e-3 * size)


def test_nothing_is_left_in_the_shared_folder(spark, small, monkeypatch, tmp_path):
    monkeypatch.setattr(L, "shared_folder", lambda spark: str(tmp_path / "rows"))
    assert L.lm_score(small).count() == small.count()
    assert not list(tmp_path.iterdir())
