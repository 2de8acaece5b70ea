"""Quality rules as a short-circuit cascade.

A document is kept if no rule rejects it. Each rule's cost (time it takes on a sample) and
its selectivity (share of the sample it rejects) are measured, and the rules are ordered by
rejection per cost. In the cascade a rule's features are computed only for documents that
no earlier rule rejected, but for those that `rules` returns for every document. The
verdict is the conjunction of all rules, so the order changes the cost and the reported
first rule, not which documents are kept.

Everything is DataFrame functions. A document's repeated 3-word windows are found within
its row, by sorting the windows' hashes with their positions.

Defined results: a null or empty text has no words and is rejected as short. Rows with
equal doc_id are judged each by its own. An empty table gives an empty table. `rules`
returns doc_id and its own columns; `apply_rules` returns the columns of the input, whatever
their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from predio.llm.common import checkpointed

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
BULLET = r"^[\x20\x09-\x0D]*[-*+\u2022]"
CUT = r"(\.\.\.|\u2026)[\x20\x09-\x0D]*$"
#: Rows of the sample, about.
SAMPLE_ROWS = 2000
#: Windows of a document up to which a hash and its position share one 64-bit number.
PACKED = 13
P = "__q_"


def c(name: str) -> Column:
    return F.col(P + name)


def kept_chars(text: Column, others: str) -> Column:
    """Number of characters that are left when runs of `others` are taken out."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def _dup_positions(ordered: Column, same: Callable, place: Callable) -> Column:
    """Sorted positions of the windows that occur twice or more. ordered: the windows by
    hash; same: whether two neighbours are equal; place: a window's position."""
    tail = F.slice(ordered, F.lit(2), F.size(ordered))
    ahead = F.zip_with(ordered, tail, lambda x, y: F.coalesce(same(x, y), F.lit(False)))
    pairs = F.zip_with(ahead, F.concat(F.array(F.lit(False)), ahead), lambda x, y: F.coalesce(x, F.lit(False)) | y)
    at = F.zip_with(pairs, ordered, lambda dup, x: F.when(dup & x.isNotNull(), place(x)))
    return F.sort_array(F.filter(at, lambda p: p.isNotNull()))


def repeat_steps() -> list[tuple[str, Column]]:
    """Columns, in order, that lead from the words to the number of repeated words."""
    low = F.lit((1 << PACKED) - 1).cast("long")
    tail = lambda a, k: F.slice(a, F.lit(k), F.size(a) + 1)
    words = lambda i: F.slice(c("words"), (i + 1).cast("int"), F.lit(3))
    packed_same = lambda x, y: (F.shiftright(x, PACKED) == F.shiftright(y, PACKED)) & (words(x.bitwiseAND(low)) == words(y.bitwiseAND(low)))
    paired_same = lambda x, y: (x["h"] == y["h"]) & (words(x["i"]) == words(y["i"]))
    pack = F.transform(c("win"), lambda x, i: x.bitwiseAND(F.lit(-(1 << PACKED)).cast("long")).bitwiseOR(i.cast("long")))
    pair = F.transform(c("win"), lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i")))
    return [
        ("h", F.transform(c("words"), lambda w: F.xxhash64(w))),
        ("h2", F.zip_with(c("h"), tail(c("h"), 2), lambda x, y: F.xxhash64(x, y))),
        ("win", F.slice(F.zip_with(c("h2"), tail(c("h"), 3), lambda x, y: F.xxhash64(x, y)), F.lit(1), F.greatest(F.size(c("h")) - 2, F.lit(0)))),
        ("some", F.size(F.array_distinct(c("win"))) < F.size(c("win"))),
        ("small", F.size(c("win")) <= (1 << PACKED)),
        ("packed", F.when(c("some") & c("small"), F.sort_array(pack))),
        ("paired", F.when(c("some") & ~c("small"), F.sort_array(pair))),
        (
            "at",
            F.when(c("packed").isNotNull(), _dup_positions(c("packed"), packed_same, lambda x: x.bitwiseAND(low)))
            .when(c("paired").isNotNull(), _dup_positions(c("paired"), paired_same, lambda x: x["i"]))
        ),
        (
            "n_repeat_words",
            F.coalesce(F.aggregate(F.zip_with(c("at"), tail(c("at"), 2), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3))).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0)).cast("long"),
        ),
    ]


def _lines() -> Column:
    return F.filter(F.split(c("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


#: The steps that make each feature.
STEPS: dict[str, list[tuple[str, Column]]] = {}


def steps(feature: str) -> list[tuple[str, Column]]:
    if not STEPS:  # columns can be made only with a session
        STEPS.update(
            {
                "n_words": [("words", F.array_remove(F.split(c("text"), BLANKS), "")), ("n_words", F.size(c("words")).cast("long"))],
                "word_chars": [("word_chars", F.length(F.array_join(c("words"), "")).cast("long"))],
                "n_symbols": [("n_symbols", kept_chars(c("text"), f"[^{SYMBOLS}]+"))],
                "n_upper": [("n_upper", kept_chars(c("text"), "[^A-Z]+"))],
                "n_letters": [("n_letters", kept_chars(c("text"), "[^A-Za-z]+"))],
                "n_lines": [("lines", _lines()), ("n_lines", F.size(c("lines")).cast("long"))],
                "n_dup_lines": [("n_dup_lines", c("n_lines") - F.size(F.array_distinct(c("lines"))))],
                "n_bullet_lines": [("n_bullet_lines", F.size(F.filter(c("lines"), lambda x: x.rlike(BULLET))).cast("long"))],
                "n_cut_lines": [("n_cut_lines", F.size(F.filter(c("lines"), lambda x: x.rlike(CUT))).cast("long"))],
                "n_repeat_words": repeat_steps(),
            }
        )
    return STEPS[feature]


@dataclass(frozen=True)
class Rule:
    """A rule's name, what it needs and when it rejects."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[], Column]


RULES = (
    Rule("short", ("n_words",), lambda: c("n_words") < MIN_WORDS),
    Rule("symbols", ("n_words", "n_symbols"), lambda: 10 * c("n_symbols") > c("n_words")),
    Rule("capitals", ("n_upper", "n_letters"), lambda: 2 * c("n_upper") > c("n_letters")),
    Rule("word_length", ("n_words", "word_chars"), lambda: (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words"))),
    Rule("dup_lines", ("n_lines", "n_dup_lines"), lambda: 10 * c("n_dup_lines") > 4 * c("n_lines")),
    Rule("bullets", ("n_lines", "n_bullet_lines"), lambda: 10 * c("n_bullet_lines") > 9 * c("n_lines")),
    Rule("cut_lines", ("n_lines", "n_cut_lines"), lambda: 10 * c("n_cut_lines") > 3 * c("n_lines")),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda: 100 * c("n_repeat_words") > 50 * c("n_words")),
)
BASE = ("short", "repeats")


def _with_feature(df: DataFrame, feature: str, guard: Column | None = None) -> DataFrame:
    for name, value in steps(feature):
        if P + name not in df.columns:
            df = df.withColumn(P + name, value if guard is None else F.when(guard, value))
    return df


def rule_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per cost, both measured on a sample of the documents: the
    share that a rule rejects, and the seconds its features take beyond reading the sample."""
    n = docs.count()
    sample = docs if n <= sample_rows else docs.sample(sample_rows / n, 7)
    sample = checkpointed(sample.select(F.coalesce("text", F.lit("")).alias(P + "text")).coalesce(4))

    def timed(value: Column, needs: tuple[str, ...] = ()) -> tuple[float, float]:
        d, best, share = sample, float("inf"), None
        for feature in needs:
            d = _with_feature(d, feature)
        for _ in range(2):  # the first one compiles
            start = time.perf_counter()
            share = d.agg(F.avg(value.cast("double"))).first()[0]
            best = min(best, time.perf_counter() - start)
        return best, share or 0.0

    idle, _ = timed(F.length(c("text")))
    gain = {}
    for r in rules:
        seconds, share = timed(r.rejects(), r.needs)
        gain[r.name] = share / max(1e-3, seconds - idle)
    return sorted(rules, key=lambda r: (-gain[r.name], r.name))


def _cascade(d: DataFrame, order: list[Rule], always: tuple[str, ...] = ()) -> DataFrame:
    """d with the features of `always`, and the first rule that rejects a row; the features
    that only later rules need are null for it."""
    for feature in always:
        d = _with_feature(d, feature)
    d = d.withColumn(P + "by", F.lit(None).cast("string"))
    for k, r in enumerate(order):
        for feature in r.needs:
            d = _with_feature(d, feature, c("by").isNull() if k else None)
        d = d.withColumn(P + "by", F.when(c("by").isNotNull(), c("by")).when(r.rejects(), r.name))
    return d


#: Features that `rules` returns.
RETURNED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rules(docs: DataFrame, order: list[Rule] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, rejected_by (first rule of the cascade, or null)."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias(P + "text"))
    d = _cascade(d, order or rule_order(docs), ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"))
    by_name = {r.name: r for r in RULES}
    base = by_name["short"].rejects() | by_name["repeats"].rejects()
    return d.select("doc_id", *[c(f).alias(f) for f in RETURNED], base.alias("base_failed"), c("by").isNull().alias("kept"), c("by").alias("rejected_by"))


def apply_rules(docs: DataFrame, order: list[Rule] | None = None) -> DataFrame:
    """The documents that every rule lets through, in the columns of docs."""
    d = docs.select(F.struct(*docs.columns).alias(P + "doc"), F.coalesce("text", F.lit("")).alias(P + "text"))
    # a row number keeps the filter above the cascade: pushed through it, the filter would
    # hold every rule's features once for each mention
    d = _cascade(d, order or rule_order(docs)).withColumn(P + "row", F.monotonically_increasing_id())
    return d.where(c("by").isNull() & (c("row") >= 0)).select(P + "doc.*")
