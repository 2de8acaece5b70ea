from brute import rules

from predio.llm import quality_rules as Q

COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def test_equals_brute_force(awkward, odd, small, nothing):
    for df in (awkward, odd, small, nothing):
        want = sorted((rules(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)
        assert sorted((tuple(r) for r in Q.rules(df).select(*COLUMNS).collect()), key=str) == want


def test_the_cascade_keeps_the_same_documents_in_any_order(awkward):
    want = {r.doc_id for r in awkward.collect() if rules(r.doc_id, r.text)[-1]}
    for order in (None, list(Q.RULES), list(reversed(Q.RULES))):
        out = Q.apply_rules(awkward, order)
        assert out.columns == awkward.columns and {r.doc_id for r in out.collect()} == want


def test_order_is_by_rejection_per_cost(spark):
    words = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(i, "# " * 80 if i % 2 else words) for i in range(40)], "doc_id long, text string")
    order = [r.name for r in Q.rule_order(df)]
    assert set(order) == {r.name for r in Q.RULES} and order.index("symbols") < order.index("capitals")


def test_no_python_on_the_main_path(awkward):
    plan = Q.apply_rules(awkward)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_both_orders_of_the_query_give_the_same_verdict(awkward):
    for order in (list(Q.RULES), list(reversed(Q.RULES))):
        out = Q.rules(awkward, order)
        want = sorted((rules(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()), key=str)
        assert sorted((tuple(r) for r in out.select(*COLUMNS).collect()), key=str) == want
        assert all((r.rejected_by is None) == r.kept for r in out.collect())
        assert "Python" not in out._jdf.queryExecution().toString()


def test_bullets_cut_lines_and_names_of_its_own(spark):
    prose = " ".join(f"word{i}" for i in range(60))
    texts = ["\n".join(f"- item {i} of a long list" for i in range(12)), "\n".join(f"line {i} goes on and on..." for i in range(12)), prose, prose + "\n\u2022 one"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, __q_by int")
    assert {r.doc_id: r.rejected_by for r in Q.rules(df).collect()} == {0: "bullets", 1: "cut_lines", 2: None, 3: None}
    assert {tuple(r) for r in Q.apply_rules(df).collect()} == {(2, prose, 2), (3, prose + "\n\u2022 one", 3)}
