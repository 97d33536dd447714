import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, fp int, c0 string, block int"
WORDS = "the of and in to loom thread weft warp été größe niño 42 x1".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and very long texts, ties, repeated rows and columns of clashing names."""
    rng = random.Random(7)
    texts = [sentence(rng, rng.randint(0, 80)) for _ in range(120)]
    texts += [None, "", "   \n\t ", "one", "A b", "Ünï <|endoftext|> x", "a  b \n\n c   d ", " lead", "漢字 кот", sentence(rng, 30_000)]
    texts += [texts[3]] * 25 + [texts[5] + " extra"]
    out = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s2", "S3", None]), 1, 1, "x", 2, None, 4) for i, t in enumerate(texts)]
    return out + [out[10], out[10], (None, texts[4], "en", "s1", None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
