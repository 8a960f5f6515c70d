import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, empty and odd ones: (doc_id, text)."""
    rng = random.Random(11)
    texts = [" ".join(words(rng, rng.randrange(1, 160))) for _ in range(60)]
    passage = " ".join(words(rng, 120))
    texts += [f"{' '.join(words(rng, 15))} {passage} {' '.join(words(rng, 15))}" for _ in range(8)]
    base = words(rng, 150)
    for _ in range(12):
        near = list(base)
        for _ in range(rng.randrange(0, 5)):
            near[rng.randrange(len(near))] = "edited"
        texts.append(" ".join(near))
    texts += [texts[3], texts[3], " ".join(base), None, "", "   ", "one", "one", "Eins zwei", "ñandú " * 120, "ab" * 700, "x" * 1500, "x" * 1500 + "y"]
    return list(enumerate(texts))


@pytest.fixture
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in corpus], DOCS)


@pytest.fixture
def make(spark):
    return lambda rows: spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
