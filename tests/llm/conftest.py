import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def make_texts(seed=3):
    """Texts with exact copies, near copies, shared passages and lines, odd spaces, empties and nulls."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "the of and rain stone river Moon été über ñu".split() for b in ("", "s", "ing", ".", ",")]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    boiler = ["All rights reserved here.", "Read our terms of use.", "Contact the office today.", "Thank you for the visit."]
    texts = []
    for i in range(60):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 14))) for _ in range(rng.randint(1, 7))]
        if i % 5 == 0:
            lines.insert(rng.randint(0, len(lines)), passage)
        if i % 4 == 0:
            lines += boiler[: rng.randint(2, 4)]
        texts.append("\n".join(lines))
    base = " ".join(rng.choice(vocabulary) for _ in range(200)).split()
    for i in range(25):  # near copies of one text
        own = list(base)
        for _ in range(i % 4):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    texts += [texts[2], texts[2].upper(), texts[7], texts[2]]
    texts += [None, "", " \t\n ", "one", "one", "two words", "a  b\x0bc\x1cd e", "word " * 3000, "x" * 100_000, "same same same same same same same same same same same same same same same same"]
    return texts


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 11 == 0 else f"src{i % 3 if i % 2 else 0}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, texts[2], "en", "src1", 1), (4, texts[4], "en", "src0", 1), (4, texts[4], "en", "src0", 1)]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def plain(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with further columns named as the operators name theirs."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(1) for c in ("h", "n", "id", "print", "key", "row", "gone", "at", "start", "part", "size", "rank", "block", "__in", "lines", "worded", "score", "blob", "todo")})
