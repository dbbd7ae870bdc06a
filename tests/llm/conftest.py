import pathlib
import random
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from helpers import prose  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, node string, spans int, __x int"


@pytest.fixture(scope="session")
def awkward_rows():
    """Texts with copies, near copies, shared passages, nulls, blanks, a very long one, repeated rows and ids."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(20, 160)) for _ in range(12)]
    texts = [*base, *base[:4], None, "", "  \n", "one two", "one two", "One  TWO", "x" * 30_000, prose(rng, 9_000)]
    for text in base[:6]:
        words = text.split()
        for share in (0.02, 0.05, 0.12, 0.3):
            texts.append(" ".join(prose(rng, 1) if rng.random() < share else w for w in words))
    passage = prose(rng, 70)
    texts += [f"{prose(rng, 15)} {passage} {prose(rng, 5)}" for _ in range(6)]
    texts += ["same line again\n" * 60, "same line again " * 45, "\U0001f600 é ß ▁x▁ \x01 a@b.org +49 123 456 789"]
    rng.shuffle(texts)
    rows = [(i * 3, t, "en", "s1", 1, True, "n", 0, 1) for i, t in enumerate(texts)]
    rows += [rows[0], rows[5], (None, texts[2], None, None, None, None, None, None, None), (None, texts[3], None, None, 0, None, "", 1, 0)]
    rows += [(rows[7][0], texts[8] if texts[8] != texts[7] else "other", "de", "s2", None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame(awkward_rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
