import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n int, key string, size string, body string, name string, place string, bucket int, digest string, salt string"


def sentence(rng, k):
    return " ".join("".join(rng.choice("aeiourstlnmd") for _ in range(rng.randint(2, 9))) for _ in range(k)) + "."


def make_texts(seed=1, n=60):
    rng = random.Random(seed)
    passage = sentence(rng, 70)
    texts = []
    for i in range(n):
        parts = [sentence(rng, rng.randint(3, 20)) for _ in range(rng.randint(1, 12))]
        if i % 5 == 0:
            parts.insert(rng.randint(0, len(parts)), passage)
        texts.append("\n".join(parts) if i % 3 else " ".join(parts))
    for i in range(0, n, 4):
        w = texts[i].split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper(), texts[7], "", "   \n\t ", "one", "a b c d", "a b c d", "same words here now ok same words here now ok same words here now ok", sentence(rng, 20_000), "Ünïcödé 漢字 😀 <|endoftext|> x", "é" * 300]
    return texts


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Ordinary texts, and edge rows: null id, text, language and source; repeated rows; extra columns with clashing names."""
    rows = [(i, t, ["en", "fr", None][i % 3], ["s0", "s1", "s0", None][i % 4], len(t)) for i, t in enumerate(texts)]
    rows += [(1000, None, "en", "s0", None), (None, "no id here at all but a few words", "en", "s1", 3), rows[3], rows[3]]
    return spark.createDataFrame([(*r, "x", 1, "k", "z", "b", "n", "p", 2, "d", "s") for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
