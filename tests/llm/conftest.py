import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, line string, k1 long, bucket int, id long"


def awkward_texts() -> list[str | None]:
    """Texts with what operators stumble over: nothing, blanks, ties, marks, long and repeated ones."""
    draw = random.Random(3)
    words = [f"{a}{b}" for a in "kolu mira tesa vento sora palu".split() for b in "bcdfghklm"]
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    shared = "This very line stands in many documents and is over forty characters"
    body = [prose(120) for _ in range(6)]
    out: list[str | None] = [None, "", " \t\n", "\n", "one", "One", "two words", "a\x00b  c", "<|endoftext|> x", "é" * 30, "日本語 のテキスト " * 12]
    out += [f"{prose(60)}\n  {shared.upper() if i % 2 else shared}\r\n{prose(10)}" for i in range(7)]
    out += [b.replace(b.split()[5], "CHANGED", 1) if k else b for b in body for k in range(3)]
    out += [body[0][:300] + " " + prose(40) + " " + body[1][200:500]] + [body[2]] * 4
    out += [shared] * 3 + [prose(9000) + "\n" + shared, "x" * 100_000, "ab " * 30_000]
    out += ["# * $ % & | < > " * 20, "WORDS IN CAPITALS " * 40, "short line\n" * 60, prose(49), prose(50)]
    return out


@pytest.fixture(scope="session")
def awkward_rows():
    texts = awkward_texts()
    return [(7 * i + 1, t, None if i % 9 == 0 else "en", ("web", "books", None, "code")[i % 4], None if i % 5 == 0 else len(t or ""), "x", i, i % 3, -i) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame(awkward_rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def odd(spark, awkward_rows):
    """The same with repeated rows, one doc_id on several texts and rows without doc_id."""
    rows = awkward_rows + awkward_rows[11:15] + [(1, "another text of the first document", None, None, None, None, None, None, None), (None, "no id at all", "en", "web", 3, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
